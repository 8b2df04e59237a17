import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sluice.llm import common as C
from sluice.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, most=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints_match_the_definition():
    for text in (None, "", " \t\n", "One", "One TWO", "a b c", "É é A a Ünter den Linden", "x y z " * 500, "a b c\x0bd\x85e f g"):
        assert S.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_keys_of_near_fingerprints_meet():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(400):
        for bit in rng.choice(64, size=i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for x in (a, b):
        at, k = S.bucket_keys(x)
        keys.append([set(k[at == i].tolist()) for i in range(400)])
    assert all(p & q for p, q in zip(*keys))


def test_bucket_links_are_exact(monkeypatch):
    monkeypatch.setattr(S, "DIRECT_ROWS", 16)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, dtype=np.uint64)
    members = np.unique([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 5), replace=False))) for _ in range(300)])
    forest = S._Forest()
    S.link_members(members.view(np.int64), forest)
    got = {}
    for x in members.view(np.int64).tolist():
        got.setdefault(forest.find(x), set()).add(x)
    want = {}
    for x, c in zip(members.view(np.int64).tolist(), brute_components(members.view(np.int64).tolist(), members.tolist())):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def _rows(seed=7):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(80)]
    rows = [(1, None), (2, ""), (3, "Solo"), (None, "solo"), (4, "a b"), (4, "a b"), (4, "other words here now")]
    for i in range(60):
        base = list(rng.choice(words, size=int(rng.integers(30, 400))))
        rows.append((100 + 5 * i, " ".join(base)))
        for j in range(1, 4):
            near = list(base)
            near[int(rng.integers(len(near)))] = "changed"
            rows.append((100 + 5 * i + j, " ".join(near)))
    return rows


def test_groups_match_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, root int").repartition(5)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicate_groups(df).collect()), key=str)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, brute_components([i for i, _ in rows], fps)), key=str)
    assert got == want
    kept = S.keep_one_per_group(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    # the two texts of doc_id 4 are in two groups, so both stay
    assert sorted(ids) == sorted([4, *{c for _, _, c in want}])


def test_overfull_buckets_are_dealt_anew(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**64, dtype=np.uint64)
    fps = np.unique([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 4), replace=False))) for _ in range(200)]).view(np.int64)
    want = brute_components(fps.tolist(), fps.tolist())
    # one bucket of all: what is held at once stays bounded, and what comes out dealt anew ends up in small buckets
    monkeypatch.setattr(S, "BUCKET_ROWS", 8)
    rows, links, rounds = [(1, (1 << 64) - 1, fps)], [], 0
    while rows:
        rounds += 1
        out = [b for key, free, m in rows for b in S._link_sorted(iter([_batch(key, free, m[i : i + 50]) for i in range(0, len(m), 50)]))]
        again = {}
        for b in out:
            for key, free, u, v in zip(*(c.to_pylist() for c in b.columns)):
                if key is None:
                    links.append((u, v))
                else:
                    again.setdefault((key, free), []).append(v)
        rows = [(key, free & (1 << 64) - 1, np.array(m, np.int64)) for (key, free), m in again.items()]
    assert 1 < rounds < 12
    forest = S._Forest()
    for u, v in links:
        forest.link(u, v)
    assert [min(fps.tolist(), key=lambda y: (forest.find(y) != forest.find(x), y)) for x in fps.tolist()] == want
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    labels = {r.vertex: r.root for r in S.connected_components(S.fingerprint_links(df)).collect()}
    assert [labels.get(x, x) for x in fps.tolist()] == want


def _batch(key, free, members):
    full = lambda x: pa.array(np.full(len(members), x & (1 << 64) - 1, np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([full(key), full(free), pa.array(members)], ["key", "free", "fp"])


def test_each_key_of_a_fingerprint_comes_once():
    rng = np.random.default_rng(6)
    at, keys = S.bucket_keys(rng.integers(0, 2**64, 500, dtype=np.uint64))
    assert len(np.unique(np.stack((at.astype(np.uint64), keys), axis=1), axis=0)) == len(keys)
    assert 55 < len(keys) / 500 < 66


@pytest.mark.parametrize("bound", [10**6, 0])
def test_one_row_stays_of_rows_repeated_and_names_may_clash(spark, monkeypatch, bound):
    monkeypatch.setattr(C.if_small, "__defaults__", (bound,))
    rows = [(1, "same text here")] * 300 + [(2, "same text here"), (None, "same text here"), (7, None), (7, None), (None, "lonely words stand here"), (None, "lonely words stand here")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, key_doc_id int, key_text int, __id int").repartition(3)
    kept = S.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "same text here"), (7, None), (None, "lonely words stand here")], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicate_groups(df).count() == 0
    assert S.keep_one_per_group(df).count() == 0
