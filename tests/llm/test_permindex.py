import numpy as np

from sluice.llm import permindex as P


def brute(rows, query_ids, n=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for q in query_ids:
        at = int(np.flatnonzero(ids == q)[0])
        scores = np.array([float(np.dot(v, x[at])) for v in x])
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:n]
        out[q] = [(int(ids[i]), scores[i]) for i in order]
    return out


def _search(spark, rows, **options):
    df = spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], 3) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in P.nearest(df.repartition(3), df.where("vec_id % 20 = 0"), **options).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [found[k] for k in sorted(found)] for q, found in got.items()}


def test_recall_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, v / np.linalg.norm(v) * s) for i, (v, s) in enumerate(zip(rng.standard_normal((3000, 48)), rng.uniform(0.5, 2, 3000)))]
    monkeypatch.setattr(P, "INDEX_BLOCK", 800)
    monkeypatch.setattr(P, "QUERY_BYTES", 60 * 48 * 8)
    got, want = _search(spark, rows, share=0.1, least=150), brute(rows, range(0, 3000, 20))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) > 0.9
    for q, found in got.items():
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
        exact = dict(brute(rows, [q], 3000)[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in found)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(300)] + [(300 + i, v) for i, v in enumerate(rng.standard_normal((200, 3)))]
    odd = [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [1.0, None, 2.0]), (1060, [float("nan"), 1.0, 1.0]), (1080, [float("inf"), 1.0, 1.0]), (1100, []), (1120, [1.0, 2.0])]
    got, want = _search(spark, rows + odd + [(5, [1.0, 2.0, 0.5])] * 2), brute(rows, range(0, 500, 20))
    assert got == want


def test_few_and_none(spark):
    assert _search(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]) == {0: [(1, 0.5), (20, 0.0)], 20: [(1, 0.5), (0, 0.0)]}
    assert _search(spark, [(0, [1.0])]) == {}
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert P.nearest(df, df).count() == 0


def test_closeness_is_the_footrule():
    rng = np.random.default_rng(2)
    x, pivots = rng.standard_normal((60, 8)), rng.standard_normal((20, 8))
    reach = float(np.sqrt((x * x).sum(1).max()))
    index = P.PermutationIndex(np.arange(60), x, pivots, reach, 7, 21)
    lists = P.nearest_pivots(P._lengthened(index.vectors, reach), index.pivots, 7)
    q = lists[0]
    def place(order, p):
        at = np.flatnonzero(order == p)
        return int(at[0]) if len(at) else 7
    footrule = np.array([sum(abs(place(o, p) - place(q, p)) for p in range(20)) for o in lists])
    close = index.closeness(q)
    assert len(set((footrule + 2 * close).tolist())) == 1
