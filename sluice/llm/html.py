"""Main text of web pages: their structure first, a host's repeated passages where it is silent.

Every page is parsed once into text blocks.  Structure settles most of them: what a page marks as its
article (or main part) stays, even where other pages repeat it; menus, headers, footers, sidebars, notices,
adverts, forms and comments, known by their tags, roles or names, go.  The rest is open: all of a page that marks
no main part, what stands in the main part beside its articles, and elements in an article whose
name only resembles one of chrome.  The token streams of a host's open blocks are put
behind each other, and a suffix array finds the passages of ``MIN_TOKENS`` or more that
different pages repeat.  These go, and the unique runs stay.  Hosts with more open tokens than one task
should hold go through counts of token runs instead, which cover the same tokens.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, if_small, slices

#: Least length of a repeated passage that counts as boilerplate.
MIN_TOKENS = 12
#: Tokens of a host's open blocks that one task sorts.
HOST_TOKENS = 2_000_000

# a quote opens a value only behind an equals sign
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
_RAW = frozenset("script style noscript template iframe object svg math canvas title textarea xmp noembed noframes".split())
_DROPPED = frozenset("nav header footer aside form menu dialog button select head audio video".split()) | _RAW
#: Words of class and id names that stand for chrome.
_NAMES = frozenset(
    (
        "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter "
        "subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus replies reply "
        "related recommended share sharing social popup modal overlay toolbar widget pagination pager skip legal copyright form search login"
    ).split()
)
#: Words that may stand beside them and leave no doubt.
_BESIDE = frozenset(
    "area bar block body bottom box btn button buttons center container content group icon icons inner item items large left link links list main message outer page panel "
    "primary right row secondary section site slot small top unit wrap wrapper zone".split()
)
_READERS = frozenset("comment comments disqus replies reply".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_CONTAINERS = frozenset("div section article main aside ul ol dl p table figure center details body".split()) | _DROPPED
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)"

_DROP, _PLAIN, _MAIN, _ARTICLE = -1, 0, 1, 2


class _Open(NamedTuple):
    """An open element: what its text is, whether that is in doubt, and where and how firmly dropping began."""

    tag: str
    level: int
    doubt: bool
    drop_at: int
    firm: bool


def _chrome(names: str) -> tuple[bool, bool, bool]:
    """Whether class and id names stand for chrome, whether they resemble such, and whether readers' comments are meant."""
    sure = like = readers = False
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if _NAMES.intersection(words):
            like = True
            if all(w in _NAMES or w in _BESIDE or w.isdigit() for w in words):
                sure, readers = True, readers or bool(_READERS.intersection(words))
    return sure, like, readers


def _opened(tag: str, attrs: str, stack: list[_Open]) -> _Open:
    """What an opening container makes of the text in it."""
    now = stack[-1] if stack else _Open("", _PLAIN, False, -1, False)
    values = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attrs)} if attrs.strip(" /") else {}
    role = values.get("role", "").lower()
    sure, like, readers = _chrome(f"{values.get('class', '')} {values.get('id', '')}") if values and tag not in ("body", "html") else (False, False, False)
    firm = tag in _DROPPED or tag == "section" or readers
    if now.level == _DROP:
        return now._replace(tag=tag, firm=now.firm or firm)
    if tag in _DROPPED or role in _ROLES or sure or "hidden" in values:
        return _Open(tag, _DROP, False, len(stack), firm)
    if tag == "article" or role == "article" or values.get("itemprop", "").lower() == "articlebody":
        return _Open(tag, _ARTICLE, now.doubt and now.level == _ARTICLE, -1, False)
    if tag == "main" or role == "main":
        return _Open(tag, max(now.level, _MAIN), now.doubt and now.level >= _MAIN, -1, False)
    return _Open(tag, now.level, now.doubt or like, -1, False)


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """The text blocks that may be a page's main text, white space made single, each with whether structure leaves it open.

    Unclosed elements end with what holds them; an advert, notice or the like left open does not swallow an article.
    """
    found: list[tuple[int, bool, str]] = []
    stack: list[_Open] = []
    is_open: Counter[str] = Counter()
    at, block, state = 0, [], (_PLAIN, False)
    now = state
    page = page or ""

    def close_block() -> None:
        nonlocal block
        if block:
            if text := " ".join("".join(block).split()):
                found.append((*state, text))
            block = []

    def cut_stack(i: int) -> None:
        nonlocal now
        for entry in stack[i:]:
            is_open[entry.tag] -= 1
        del stack[i:]
        now = stack[-1][1:3] if stack else (_PLAIN, False)

    while True:
        m = _MARKUP.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and now[0] != _DROP:
            if state != now:
                close_block()
                state = now
            block.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if (data := m["data"]) is not None and now[0] != _DROP:
            if state != now:
                close_block()
                state = now
            block.append(data)
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            close_block()
        if m["close"]:
            if tag in _CONTAINERS and is_open[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                cut_stack(i)
            continue
        attrs = m["attrs"]
        if tag in _RAW and not attrs.endswith("/"):
            # what follows is not markup, up to the closing tag
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
            continue
        if tag in _EMPTY or tag in _HEADINGS or tag not in _CONTAINERS:
            continue
        if tag in ("p", "li") and stack and stack[-1].tag == tag:
            cut_stack(len(stack) - 1)
        if tag in ("article", "main") and stack and stack[-1].level == _DROP and not stack[-1].firm:
            # an element dropped by its name was left open before the article
            cut_stack(stack[-1].drop_at)
        stack.append(_opened(tag, attrs, stack))
        is_open[tag] += 1
        now = stack[-1][1:3]
    close_block()
    levels = {level for level, *_ in found}
    if _ARTICLE in levels:
        return [(text, doubt or level == _MAIN) for level, doubt, text in found if level >= _MAIN]
    if _MAIN in levels:
        return [(text, doubt) for level, doubt, text in found if level == _MAIN]
    return [(text, True) for _, _, text in found]


def repeated_tokens(pages: list[list[str]], least: int = MIN_TOKENS) -> list[np.ndarray]:
    """For each page, which tokens lie in a run of ``least`` or more that another page repeats.

    The pages, which must differ, are put behind each other with a separator each; the suffixes
    are sorted by their first ``least`` tokens by doubling, and neighbours that agree on these
    are the repeats.
    """
    sizes = np.array([len(p) + 1 for p in pages], np.int64)
    total = int(sizes.sum())
    names: dict[str, int] = {}
    flat = np.empty(total, np.int64)
    at = 0
    for k, page in enumerate(pages):
        flat[at : at + len(page)] = [names.setdefault(t, len(names)) for t in page]
        flat[at + len(page)] = -1 - k
        at += len(page) + 1
    owner = np.repeat(np.arange(len(pages)), sizes)
    rank = np.unique(flat, return_inverse=True)[1]
    width = 1
    while width < least:
        step = min(width, least - width)
        after = np.full(total, -1, np.int64)
        after[: total - step] = rank[step:]
        order = np.lexsort((after, rank))
        fresh = np.ones(total, bool)
        fresh[1:] = (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)
        rank = np.empty(total, np.int64)
        rank[order] = np.cumsum(fresh)
        width += step
    order = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(rank[order]) != 0)) if total else np.zeros(0, np.int64)
    low, high = (f.reduceat(owner[order], starts) for f in (np.minimum, np.maximum)) if total else (starts, starts)
    shared = np.repeat(low != high, np.diff(np.append(starts, total)))
    edge = np.zeros(total + least + 1, np.int64)
    begins = order[shared]
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + least, -1)
    covered = np.cumsum(edge)[:total] > 0
    ends = np.cumsum(sizes)
    return [covered[e - n : e - 1] for e, n in zip(ends, sizes)]


def open_tokens(texts: list[str], asks: list[bool]) -> list[str]:
    return [t for text, ask in zip(texts, asks) if ask for t in text.split(" ")]


def without_repeats(texts: list[str], asks: list[bool], covered: np.ndarray) -> str:
    """The blocks of a page without the tokens of its open ones that are covered."""
    out, at = [], 0
    for text, ask in zip(texts, asks):
        if ask:
            tokens = text.split(" ")
            text = " ".join(t for t, c in zip(tokens, covered[at : at + len(tokens)]) if not c)
            at += len(tokens)
        if text:
            out.append(text)
    return " ".join(out)


def _host_pages(pages: pd.DataFrame) -> pd.DataFrame:
    """One host's pages without the passages that pages of different text repeat."""
    first = pages.drop_duplicates("page_key")
    covered = dict(zip(first["page_key"], repeated_tokens([open_tokens(t, a) for t, a in zip(first["texts"], first["asks"])])))
    texts = [without_repeats(t, a, covered[k]) for t, a, k in zip(pages["texts"], pages["asks"], pages["page_key"])]
    return pd.DataFrame({"page_id": pages["page_id"], "url": pages["url"], "text": texts})


def _gram(tokens: str, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(F.col(tokens), at + i) for i in range(n)])


def _large_hosts(pages: DataFrame) -> DataFrame:
    """The same by counts: the runs of ``MIN_TOKENS`` that more than one page text of a host has."""
    asked = F.filter(F.arrays_zip("texts", "asks"), lambda b: b["asks"])
    tokens = F.flatten(F.transform(asked, lambda b: F.split(b["texts"], " ")))
    streams = pages.select("host", "page_key", tokens.alias("tokens")).dropDuplicates(["host", "page_key"])
    last = F.size("tokens") - MIN_TOKENS
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    runs = streams.select("host", "page_key", "tokens", F.explode(starts).alias("at")).select("host", "page_key", "at", _gram("tokens", F.col("at"), MIN_TOKENS).alias("gram"))
    repeated = runs.groupBy("host", "gram").agg(F.min("page_key").alias("a"), F.max("page_key").alias("b")).where("a <> b").select("host", "gram")
    hits = runs.join(repeated, ["host", "gram"], "left_semi").groupBy("host", "page_key").agg(F.collect_list("at").alias("hits"))
    joined = pages.join(hits, ["host", "page_key"], "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts, asks, found in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                n = len(open_tokens(texts, asks))
                edge = np.zeros(n + 1, np.int64)
                at = np.array(found or [], np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + MIN_TOKENS, -1)
                out.append(without_repeats(texts, asks, np.cumsum(edge)[:n] > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "texts", "asks", "hits").mapInArrow(strip, "page_id long, url string, text string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page of ``pages`` (page_id, url, html).

    A null or empty html gives an empty text; a page of a null url belongs to a host without a name; pages of one
    text count as one page when repeats are sought; repeated rows and null ids are kept; an
    empty table gives no rows; other columns are not read.
    """
    settled_names, names = ["page_id", "url", "text", "texts", "asks"], "page_id long, url string, text string, texts array<string>, asks array<boolean>"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [blocks(h) for h in batch.column(2).to_pylist()]
            asked = [any(ask for _, ask in b) for b in found]
            texts = pa.array([None if a else " ".join(t for t, _ in b) for a, b in zip(asked, found)], pa.string())
            parts = pa.array([[t for t, _ in b] if a else None for a, b in zip(asked, found)], pa.list_(pa.string()))
            asks = pa.array([[x for _, x in b] if a else None for a, b in zip(asked, found)], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, parts, asks], settled_names)

    parsed = cut(pages.select("page_id", "url", "html").mapInArrow(parse, names))
    settled = parsed.where("text is not null").select("page_id", "url", "text")
    rest = parsed.where("text is null")
    if rest.isEmpty():
        return settled
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    rest = rest.select("page_id", "url", "texts", "asks", host.alias("host"), F.xxhash64("texts").alias("page_key"))
    n = F.aggregate(F.arrays_zip("texts", "asks"), F.lit(0), lambda total, b: total + F.when(b["asks"], F.size(F.split(b["texts"], " "))).otherwise(0))
    large = cut(rest.groupBy("host").agg(F.sum(n).alias("n")).where(F.col("n") > HOST_TOKENS).select("host"))
    if large.isEmpty():
        return settled.unionByName(_small_hosts(rest))
    large = if_small(large)
    return settled.unionByName(_small_hosts(rest.join(large, "host", "left_anti"))).unionByName(_large_hosts(rest.join(large, "host", "left_semi")))


def _small_hosts(rest: DataFrame) -> DataFrame:
    return rest.groupBy("host").applyInPandas(_host_pages, "page_id long, url string, text string")
