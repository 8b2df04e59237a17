import os
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from sluice.llm import html as H


def text(page):
    return " ".join(t for t, _ in H.blocks(page))


class _Independent(HTMLParser):
    """Text of articles alone, by the standard library's parser; only for pages whose chrome stands outside."""

    BREAKS = {"p", "h1", "br", "article", "div"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in self.BREAKS:
            self.parts.append("\0")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in self.BREAKS:
            self.parts.append("\0")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)

    def text(self):
        blocks = (" ".join(b.split()) for b in "".join(self.parts).split("\0"))
        return " ".join(b for b in blocks if b)


def test_given_pages_against_an_independent_parser(spark):
    if not os.path.exists("/root/testdata/sf0.01/pages.parquet"):
        pytest.skip("no pages here")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    rows = pages.collect()
    for r in rows:
        parser = _Independent()
        parser.feed(r.html or "")
        parser.close()
        assert got[r.page_id] == parser.text(), r.page_id
    assert len(got) == len(rows) > 200


def test_quotes_names_and_titles():
    assert text("<article><p title=it's>Hello there</p><p>I don't know</p></article>") == "Hello there I don't know"
    assert text("<article><p data-a='x>y' title = \"a>b\">c</p><p a=b=\"c\">d</article>") == "c d"
    page = '<article><div class="search-tips">Tips.</div><p class="legal-history">Law.</p><section id="share-prices">Share prices rose.</section></article>'
    assert H.blocks(page) == [("Tips.", True), ("Law.", True), ("Share prices rose.", True)]
    assert H.blocks("<main><h1>Title</h1><article>x</article></main>y") == [("Title", True), ("x", False)]
    for name in ("ad", "ad-slot", "cookieBanner", "newsletter-signup", "comment-list", "share_buttons", "related", "ad-2"):
        assert text(f'<article>a<div class="{name}">gone</div>b</article>') == "a b", name
    assert text('<div class="comments"><article>me too</article></div><article>a</article>') == "a"
    assert text('<article class="post with-sidebar">a</article>') == "a"


def test_deep_nesting_takes_linear_time():
    began = time.process_time()
    n = 60_000
    assert text("<div>" * n + "</p>" * n + "<article>x") == "x"
    assert text("<div class=ad>" * n + "<article>x" * n).startswith("x x")
    assert text("<section>" * n + "</div></section>" * n + "<p a=" * n) == ""
    assert time.process_time() - began < 20


def test_structure():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav>'
        '<!-- ad --><div class="ad">buy</div><article><h1>Head &amp</h1><p><b>One<br><p>Two &lt;b&gt;  three\n four&nbsp;five</p>a<i>b</i>c<div class="cookie-notice">no</div>'
        '<form><p>mail</p></form><aside>see also</aside><section id="comments"><article class="comment">me too</article></section><p>End</article><footer>&copy; x'
    )
    assert text(page) == "Head & One Two <b> three four five abc End"
    assert text("<div class=ad>open<article><p>kept</article>") == "kept"
    assert text("<main><p>a</p><nav>b</nav>c</main>d") == "a c"
    assert text("<article><header>x</header>y<p class='lead'>z</article><article>w</article>") == "y z w"
    assert text("a < b <p>c<!-- open") == "a < b c"
    assert text("<article>x<script>if (a</b) </script>y</article>") == "x y"
    assert [text(t) for t in (None, "", "<p>", "plain", "<<>>&&&")] == ["", "", "", "plain", "<<>>&&&"]
    assert H.blocks("<p>x") == [("x", True)] and H.blocks("<article>x") == [("x", False)]


def brute(pages, least):
    runs = {}
    for k, p in enumerate(pages):
        for i in range(len(p) - least + 1):
            runs.setdefault(tuple(p[i : i + least]), set()).add(k)
    out = []
    for p in pages:
        mask = np.zeros(len(p), bool)
        for i in range(len(p) - least + 1):
            if len(runs[tuple(p[i : i + least])]) > 1:
                mask[i : i + least] = True
        out.append(mask)
    return out


def test_suffix_array_against_brute_force():
    rng = random.Random(0)
    for trial in range(60):
        pages = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(1, 6))]
        least = rng.randint(1, 9)
        for got, want in zip(H.repeated_tokens(pages, least), brute(pages, least)):
            assert (got == want).all()


@pytest.mark.parametrize("bound", [10**6, 0])
def test_unmarked_pages_lose_what_their_host_repeats(spark, monkeypatch, bound):
    monkeypatch.setattr(H, "HOST_TOKENS", bound)
    frame = " ".join(f"menu{i}" for i in range(15))
    rows = [(i, f"http://h{i % 2}.example/p{i}", f"<div><p>{frame} {i % 2}</p><p>w{i}a w{i}b w{i}c</p></div>") for i in range(8)]
    rows += [(50, "http://h0.example/m", f"<article>{frame} kept</article>"), (51, None, f"<p>{frame}"), (52, "http://h2.example", None), (52, "http://h2.example", None)]
    rows += [(60, "http://h3.example/a", f"<p>{frame} same"), (61, "http://h3.example/b", f"<p>{frame} same"), (None, "bad url", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, tokens int").repartition(3)
    got = sorted(((r.page_id, r.text) for r in H.extract(df).collect()), key=str)
    want = [(i, f"w{i}a w{i}b w{i}c") for i in range(8)] + [(50, f"{frame} kept"), (51, frame), (52, ""), (52, ""), (60, f"{frame} same"), (61, f"{frame} same"), (None, "")]
    assert got == sorted(want, key=str)
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [10**6, 0])
def test_open_blocks_of_marked_pages_lose_what_their_host_repeats(spark, monkeypatch, bound):
    monkeypatch.setattr(H, "HOST_TOKENS", bound)
    tips = " ".join(f"tip{i}" for i in range(14))
    shared = " ".join(f"quote{i}" for i in range(20))
    page = '<main><h1>Title {0}</h1><article><p>{2}</p><div class="search-tips">{1}</div><p class="share-prices">only{0} here</p></article></main>'
    rows = [(i, "http://h.example/p", page.format(i, tips, shared)) for i in range(6)]
    rows += [(9, "http://other.example/p", page.format(9, tips, shared))] + [(7, "http://h.example/copy", page.format(0, tips, shared))] * 30
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {(r.page_id, r.text) for r in H.extract(df).collect()}
    # what the article itself repeats stays, and so do the tips on a host with one page
    want = {(i, f"Title {i} {shared} only{i} here") for i in range(6)} | {(7, f"Title 0 {shared} only0 here"), (9, f"Title 9 {shared} {tips} only9 here")}
    assert got == want


def test_a_host_against_brute_force(spark):
    rng = random.Random(8)
    phrases = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 20))) for _ in range(12)]
    rows = [(i, "http://h.example/", "".join(f"<p>{rng.choice(phrases)} {rng.randint(0, 99)}</p>" for _ in range(rng.randint(0, 6)))) for i in range(80)]
    texts = {h: " ".join(t for t, _ in H.blocks(h)) for _, _, h in rows}
    distinct = [t.split(" ") for t in dict.fromkeys(texts.values())]
    mask = {" ".join(p): m for p, m in zip(distinct, brute(distinct, H.MIN_TOKENS))}
    want = sorted((i, " ".join(t for t, c in zip(texts[h].split(" "), mask[texts[h]]) if not c)) for i, _, h in rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in H.extract(df).collect()) == want
