import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.llm import common as C
from sluice.llm import winnow as N


def brute(docs, items):
    def words(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    windows = {}
    for item_id, text in items:
        w = words(text)
        for j in range(max(1, len(w) - 7)) if w else ():
            windows.setdefault(tuple(w[j : j + 8]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), tuple(ids), len(ids) >= 2))
    return sorted(out, key=str)


def _tables():
    rng = random.Random(2)
    word = lambda: rng.choice("ab cd Ef GH éÉ ij1 k2 l m ß".split())
    text = lambda n: rng.choice(" \n,.-").join(word() for _ in range(n))
    items = [(1, None), (2, ""), (3, "Ab cd"), (4, "x-y z one two three four"), (None, "lost item words go here one two three"), (5, "same " * 20), (6, "same " * 9)]
    items += [(10 + i, text(rng.randint(6, 40))) for i in range(20)]
    docs = [(1, None), (2, ""), (3, "ab"), (3, "ab"), (None, "AB, CD!"), (4, "same " * 15), (5, "X Y Z ONE TWO three FOUR five"), (6, "lost item words go here one two three")]
    for i in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 1))
            parts += [" ".join(w[a : a + rng.randint(1, 30)]), text(rng.randint(0, 9))]
        docs.append((100 + i, " ".join(parts)))
    docs.append((999, " ".join(text(50) for _ in range(400)) + " " + items[-1][1]))
    return docs, items


@pytest.mark.parametrize("bound", [10**6, 0])
def test_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(N, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(N, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(C.if_small, "__defaults__", (bound,))
    docs, items = _tables()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, items string, gram int").repartition(3)
    b = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, n int")
    found = N.contamination(d, b)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.collect()), key=str)
    want = brute(docs, items)
    assert got == want
    kept = N.drop_contaminated(d, b)
    assert kept.columns == d.columns
    bad = {(r[0], r[1]) for r in want if r[4]}
    assert kept.count() == sum(not r[4] for r in want) and bad


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert N.contamination(d, b).count() == 0
    assert [(r.n_words, r.n_hit, r.contaminated) for r in N.contamination(one, b).collect()] == [(8, 0, False)]


def test_one_window_in_very_many_items(spark):
    passage = "one window that very many items of the benchmark hold"
    b = spark.range(30_000).selectExpr("id AS item_id", f"concat('{passage} ', id) AS text")
    d = spark.createDataFrame([(1, f"x {passage} y"), (2, "nothing of the kind"), (3, passage)], "doc_id long, text string")
    got = {r.doc_id: (len(r["items"]), r.n_hit) for r in N.contamination(d, b).collect()}
    assert got == {1: (30_000, 10), 2: (0, 0), 3: (30_000, 10)}


def test_names_that_clash(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h", 1, 2, 3), (2, "z", 1, 2, 3)], "doc_id long, text string, key_doc_id int, key_text int, __id int")
    b = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    kept = N.drop_contaminated(d, b, min_items=1)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
