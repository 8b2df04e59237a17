import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import common as C
from sluice.llm import packing as K


def test_plans_keep_every_piece_and_swaps_never_add_bins():
    rng = random.Random(4)
    for trial in range(20):
        counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
        first = K.best_fit_decreasing(counts, 100)
        better = K.improve_by_swaps(first, 100)
        for plan in (first, better):
            packed = Counter()
            for content, n in plan.items():
                assert n > 0 and 0 < sum(content) <= 100
                for x in content:
                    packed[x] += n
            assert packed == Counter(counts)
        assert sum(better.values()) <= sum(first.values())


def test_swaps_empty_a_bin():
    # 6+3 and 4+4 and 3 fill three bins of ten; 6+4 and 4+3+3 fill two
    assert sum(K.improve_by_swaps(Counter({(6, 3): 1, (4, 4): 1, (3,): 1}), 10).values()) == 2


def _steps_left(patterns, capacity):
    """Whether any move or swap between two underfull bins fills the fuller one more, by trying all."""
    for donor in patterns:
        pieces = sorted(set(donor))
        gifts = {(x,) for x in pieces} | {(x, y) for x in pieces for y in pieces if x < y or (x == y and donor.count(x) > 1)}
        for target, n in patterns.items():
            room = capacity - sum(target)
            if sum(donor) < capacity and sum(target) >= sum(donor) and (target != donor or n > 1):
                if any(0 < sum(g) - back <= room for g in gifts for back in (0, *target)):
                    return True
    return False


def test_swaps_go_on_until_none_is_left():
    rng = random.Random(9)
    small = [Counter({tuple(sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 3))), reverse=True)): rng.randint(1, 3) for _ in range(40)}) for _ in range(20)]
    small = [Counter({p: n for p, n in c.items() if sum(p) <= 100}) for c in small]
    # in the second, the two pieces that fit stand behind 64 others
    many = [Counter({(400 + i, 290): 1 for i in range(300)} | {(700, 31 + i % 90, 3): 1 for i in range(300)}), Counter({(3,) * 64 + (1, 1): 1, (*[6] * 32, 5, 1): 2})]
    for plan, capacity in [*((c, 100) for c in small), (many[0], 1024), (many[1], 200)]:
        better = K.improve_by_swaps(plan, capacity)
        least = -(-sum(sum(p) * n for p, n in plan.items()) // capacity)
        pieces = lambda c: sum((Counter({x: k * n for x, k in Counter(p).items()}) for p, n in c.items()), Counter())
        assert pieces(better) == pieces(plan) and all(0 < sum(p) <= capacity for p in better) and min(better.values()) > 0
        assert sum(better.values()) == least or not _steps_left(better, capacity)


def test_packing_against_the_tokenizer(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "a", "Hello world! " * 700, "naïve café — 你好 <|endoftext|> x", "\x1c! \x1cb", "z" * 3000]
    texts += [" ".join(rng.choice(["alpha", "beta", "gamma,"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(i if i != 3 else None, t, 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, offset int").repartition(4)
    got = K.pack_documents(df).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        cut = len(ids) % 1024 or 1024
        bounds = [0, *range(cut, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want.append((doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(w[3] for w in want) // 1024) + 2


@pytest.mark.parametrize("bound", [10**6, 0])
def test_a_million_equal_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(C.if_small, "__defaults__", (bound,))
    n = 1_000_000 if bound else 20_000
    rows = spark.range(n, numPartitions=8).selectExpr("cast(null as long) AS doc_id", "cast(null as string) AS text")
    got = K.pack_documents(rows.unionByName(spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")))
    tasks = got.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert max(r["count"] for r in tasks) <= n / 8 + 2 or not bound
    shape = got.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces"), F.max(F.col("offset") + F.col("length")).alias("end"))
    filled = shape.agg(F.count("*"), F.max("fill"), F.sum(F.expr("int(places <> pieces or end <> fill)")), F.sum("pieces")).first()
    tokens = got.agg(F.sum("length")).first()[0]
    assert tuple(filled) == (-(-tokens // 1024), 1024, 0, n + 2)


def test_empty_table(spark):
    assert K.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_columns_follow_each_piece(spark):
    rows = [(1, "a b c", "aa", 7), (2, "word " * 3000, None, 8), (None, None, "bb", None), (3, "x", "aa", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, rank int").repartition(2)
    got = K.pack_documents(df, also=("lang",)).collect()
    assert {(r.doc_id, r.lang) for r in got} == {(r[0], r[2]) for r in rows}
    assert len(got) == K.pack_documents(df).count() > len(rows)
    assert {r["rank"] for r in K.pack_documents(df.drop("lang"), also=("rank",)).collect()} == {7, 8, None, 9}
