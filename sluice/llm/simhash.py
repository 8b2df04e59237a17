"""SimHash near-duplicate groups found through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded
with zeros).  The perfect binary [23,12,7] code sends every 23-bit word to one
codeword at distance three or less, and the words within one bit of a segment
decode to one codeword or six.  Two fingerprints at distance three or less have
either one error in each segment, or one segment without error beside another
with at most one (pigeonhole).  So they meet under one of these keys:

* ``K(s0) x K(s1) x d(s2)`` of one and ``d(s0) x d(s1) x K(s2)`` of the other,
* ``s_i x K(s_j)`` of both, for i != j,

where ``d`` decodes a segment and ``K`` decodes its one-bit ball.  The keys have 35
or 36 bits, and a fingerprint has each of its keys once (some 61).  Keys that only one
fingerprint has are dropped before any row reaches Python.  Members of a bucket are compared
exactly; a bucket yields a spanning forest of its links, not all its pairs, and the rows of buckets
over a bound are dealt anew by a fourth of the bits that are still free to differ, as often as
it takes: a linked pair agrees on one fourth at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import PART_ROWS, cut, map_batches, without_keys

SHINGLE = 3
MAX_BITS = 3
#: Members of a bucket that one task holds at once; larger buckets are dealt anew.
BUCKET_ROWS = 1 << 18
#: Rows (key, fingerprint) that one task sorts.
TASK_ROWS = 1 << 20
#: Links that a task holds back to tell repeated ones.
LINK_ROWS = 1 << 16
#: Members that are compared one by one; more are cut by 16-bit blocks first.
DIRECT_ROWS = 1 << 12

_GENERATOR = 0b101011100011
_MASK23 = (1 << 23) - 1


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: majority bits of its shingles' XXH64 (seed 42)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    step = 1 << 16
    for at in range(0, n, step):
        part = words[at : min(at + step, n) + width - 1]
        grams = [b" ".join(g) for g in zip(*(part[i:] for i in range(width)))] if len(words) >= width else [b" ".join(words)]
        digest = xxhash.xxh64_digest
        raw = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, a hash of the text and the signed 64-bit fingerprint of every row's whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        values = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values.view(np.int64))], ["doc_id", "text_key", "fp"])

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), run, "doc_id long, text_key long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> np.uint32(bit) & np.uint32(1), np.uint32(_GENERATOR << (bit - 11)), np.uint32(0))
    return rest


class Golay:
    """Decoder of the perfect binary Golay code by a table of syndromes."""

    def __init__(self) -> None:
        one = [1 << i for i in range(23)]
        errors = [0, *one]
        errors += [a | b for i, a in enumerate(one) for b in one[:i]]
        errors += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
        patterns = np.array(errors, np.uint32)
        self.error = np.zeros(2048, np.uint32)
        self.error[_syndrome(patterns)] = patterns
        self.low = _syndrome(np.arange(1 << 12, dtype=np.uint32))
        self.high = _syndrome(np.arange(1 << 11, dtype=np.uint32) << np.uint32(12))

    def decode(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword nearest to each 23-bit word."""
        words = words.astype(np.uint32)
        syndrome = self.low[words & np.uint32(0xFFF)] ^ self.high[words >> np.uint32(12)]
        return (words ^ self.error[syndrome]) >> np.uint32(11)

    def ball(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (position, index): each codeword index of a word's one-bit ball, once."""
        words = words.astype(np.uint32)
        flips = np.array([0, *(1 << i for i in range(23))], np.uint32)
        found = np.sort(self.decode((words[:, None] ^ flips).ravel()).reshape(len(words), 24), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        at, column = np.nonzero(first)
        return at, found[at, column]


_golay: Golay | None = None


def golay() -> Golay:
    global _golay
    if _golay is None:
        _golay = Golay()
    return _golay


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) rows under which fingerprints three bits apart surely meet."""
    code = golay()
    fps = fps.view(np.uint64)
    segments = [(fps >> np.uint64(41)) & np.uint64(_MASK23), (fps >> np.uint64(18)) & np.uint64(_MASK23), fps & np.uint64((1 << 18) - 1)]
    near = [code.decode(s).astype(np.uint64) for s in segments]
    balls = [code.ball(s) for s in segments]
    everyone = np.arange(len(fps))
    rows: list[np.ndarray] = []
    keys: list[np.ndarray] = []

    def put(at: np.ndarray, kind: int, high: np.ndarray, low: np.ndarray) -> None:
        rows.append(at)
        keys.append(np.uint64(kind << 36) | high.astype(np.uint64) << np.uint64(12) | low.astype(np.uint64))

    # one error in each segment: the product of two balls meets one ball
    at1, k1 = balls[1]
    starts, sizes = np.searchsorted(at1, everyone), np.bincount(at1, minlength=len(fps))
    at0, k0 = balls[0]
    repeat = sizes[at0]
    left = np.repeat(np.arange(len(at0)), repeat)
    within = np.arange(len(left)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    right = starts[at0[left]] + within
    who = at0[left]
    put(who, 0, k0[left].astype(np.uint64) << np.uint64(12) | k1[right].astype(np.uint64), near[2][who])
    at2, k2 = balls[2]
    other = k2 != near[2][at2]  # the product holds this one already
    put(at2[other], 0, (near[0] << np.uint64(12) | near[1])[at2[other]], k2[other])
    # a segment without error beside one with at most one
    kind = 1
    for i in range(3):
        for j in range(3):
            if i != j:
                at, k = balls[j]
                put(at, kind, segments[i][at], k)
                kind += 1
    return np.concatenate(rows), np.concatenate(keys)


class _Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.parent.setdefault(min(a, b), min(a, b))


def link_members(members: np.ndarray, forest: _Forest, most: int = MAX_BITS, free: tuple[int, ...] = tuple(range(64))) -> None:
    """Join the distinct fingerprints of one bucket that are ``most`` bits apart or nearer.

    They agree on all bits outside ``free``.  Many members are first cut into
    ``most + 1`` blocks of the free bits: a linked pair agrees on one of them.
    """
    if len(members) > DIRECT_ROWS and len(free) >= 4 * (most + 1):
        for b in range(most + 1):
            block = free[b :: most + 1]
            order = np.argsort(part := members.view(np.uint64) & np.uint64(sum(1 << i for i in block)), kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for group in np.split(members[order], cuts):
                if len(group) > 1:
                    link_members(group, forest, most, tuple(i for i in free if i not in block))
        return
    waiting, frontier = members, []
    while len(waiting):
        if not frontier:
            frontier, waiting = [waiting[0]], waiting[1:]
        x = np.int64(frontier.pop())
        close = np.bitwise_count(waiting.view(np.uint64) ^ x.view(np.uint64)) <= most
        if close.any():
            for y in waiting[close].tolist():
                forest.link(int(x), y)
                frontier.append(y)
            waiting = waiting[~close]


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))


_NAMES = ["key", "free", "u", "v"]
_SCHEMA = "key long, free long, u long, v long"


def _bits(mask: int) -> tuple[int, ...]:
    return tuple(i for i in range(64) if mask >> i & 1)


def deal_anew(key: int, free: int, members: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of an overfull bucket under four keys each, one for each fourth of the bits ``free`` to differ."""
    bits = _bits(free)
    for b in range(MAX_BITS + 1):
        mask = sum(1 << i for i in bits[b :: MAX_BITS + 1])
        h = members.view(np.uint64) & np.uint64(mask)
        for salt in (key & (1 << 64) - 1, b + 1):
            h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(27)
        left = np.full(len(members), free & ~mask, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(left), pa.nulls(len(members), pa.int64()), pa.array(members)], _NAMES)


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of the buckets of rows (key, free, fp) sorted by key; rows of overfull buckets come out dealt anew, in v."""
    waiting: list[np.ndarray] = []
    size = 0
    held_key, held_free, held, overfull = None, 0, np.zeros(0, np.int64), False

    def links() -> pa.RecordBatch:
        nonlocal waiting, size
        pairs = np.unique(np.concatenate(waiting), axis=0)
        waiting, size = [], 0
        none = pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], _NAMES)

    def put(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal size
        if len(u):
            waiting.append(np.stack((np.maximum(u, v), np.minimum(u, v)), axis=1))
            size += len(u)

    def close_bucket() -> None:
        if len(held) < 2 or overfull:
            return
        forest = _Forest()
        link_members(held, forest, free=_bits(held_free))
        linked = np.array([(v, forest.find(v)) for v in forest.parent], np.int64).reshape(-1, 2)
        linked = linked[linked[:, 0] != linked[:, 1]]
        put(linked[:, 0], linked[:, 1])

    for batch in batches:
        keys, frees, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        if not len(keys):
            continue
        edges = _runs(keys)
        sizes = np.diff(edges)
        # the first run may go on from the batch before, the last one into the next
        inner = (np.arange(len(sizes)) > 0) & (np.arange(len(sizes)) < len(sizes) - 1)
        twos = edges[:-1][inner & (sizes == 2)]
        u, v = fps[twos], fps[twos + 1]
        near = np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= MAX_BITS
        put(u[near], v[near])
        for r in np.flatnonzero(~inner | (sizes > 2)):
            lo, hi = edges[r], edges[r + 1]
            if held_key is None or keys[lo] != held_key:
                close_bucket()
                held_key, held_free, held, overfull = keys[lo], int(frees[lo]) & (1 << 64) - 1, fps[lo:hi], False
            else:
                held = np.concatenate((held, fps[lo:hi]))
            if overfull or (len(held) > BUCKET_ROWS and held_free.bit_count() > MAX_BITS):
                overfull = True
                yield from deal_anew(int(held_key), held_free, held)
                held = np.zeros(0, np.int64)
        if size > LINK_ROWS:
            yield links()
    close_bucket()
    if size:
        yield links()


def fingerprint_links(distinct: DataFrame, n: int | None = None) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints of column ``fp``, ``n`` of them, as all links do."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(start, 4096).to_numpy()
                at, keys = bucket_keys(fps)
                free = np.full(len(keys), -1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(free), pa.array(fps[at])], ["key", "free", "fp"])

    def linked(rows: DataFrame, parts: int) -> DataFrame:
        # buckets of one fingerprint go in the JVM; the window leaves the others sorted by key
        met = F.count(F.lit(1)).over(W.partitionBy("key"))
        dealt = rows.repartition(parts, "key").withColumn("met", met).where("met > 1").select("key", "free", "fp")
        # a part of 61 rows for each fingerprint is a task's share here
        return cut(dealt.mapInArrow(_link_sorted, _SCHEMA), parts * PART_ROWS)

    parts = max(1, -(-(distinct.count() if n is None else n) * 61 // TASK_ROWS))
    rows = distinct.select("fp").repartition(parts).mapInArrow(keyed, "key long, free long, fp long")
    edges = None
    while True:
        found = linked(rows, parts)
        links = found.where("key is null").select("u", "v")
        edges = links if edges is None else edges.unionByName(links)
        rows = found.where("key is not null").select("key", "free", F.col("v").alias("fp"))
        if not (left := rows.count()):
            return edges
        parts = max(1, -(-left // TASK_ROWS))


def connected_components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (u, v), ``n`` at most; the root is its component's least vertex.

    Labels take the minimum over neighbours, then jump to their label's label, until
    nothing changes.  Hubs meet only in aggregates that are summed before the shuffle
    and in joins that the engine can split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    # links repeat in buckets, but are distinct here: some for each vertex
    both = cut(both, None if n is None else 4 * n)
    labels = cut(both.groupBy(F.col("u").alias("vertex")).agg(F.least(F.min("v"), F.col("vertex")).alias("root")), n)
    while True:
        offered = (
            both.join(labels.select(F.col("vertex").alias("v"), F.col("root").alias("offer")), "v")
            .groupBy(F.col("u").alias("vertex"))
            .agg(F.min("offer").alias("offer"))
        )
        merged = labels.join(offered, "vertex", "left").select(
            "vertex", F.col("root").alias("before"), F.least("root", F.coalesce("offer", "root")).alias("root")
        )
        jump = labels.select(F.col("vertex").alias("root"), F.col("root").alias("up"))
        after = cut(
            merged.join(jump, "root", "left").select("vertex", "before", F.least("root", F.coalesce("up", "root")).alias("root")), n
        )
        labels = after.select("vertex", "root")
        if after.where("root <> before").isEmpty():
            return labels


def _grouped(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text_key, fp, root and component_id of every row, and how many there are."""
    prints = cut(with_fingerprints(docs))
    rows = prints.count()
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), rows)
    n = distinct.count()
    roots = connected_components(fingerprint_links(distinct, n), n)
    placed = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(placed.join(least, "root").select("fp", "root", "component_id"), n)
    return prints.join(named, "fp"), rows


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long) and component_id.

    Rows whose fingerprints differ in three bits or fewer are linked; component_id is
    the smallest doc_id that links reach.  A null or empty text has fingerprint zero and is
    linked like any other; equal texts, repeated rows included, fall together; null doc_ids
    stay and do not count as smallest (null if a component has no other).  An empty table
    gives no rows; columns beside doc_id and text are not read.
    """
    return _grouped(docs)[0].select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of its smallest doc_id.

    Of rows that repeat one doc_id and text any one stays.  All columns stay as they are, whatever
    their names.  Texts move only if the rows to drop are too many to broadcast their keys.
    """
    grouped, n = _grouped(docs)
    rows = cut(grouped.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), n)
    best = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key", "n")).alias("b"))
    best = cut(best.select("root", F.col("b.doc_id").alias("best_id"), F.col("b.text_key").alias("best_key"), F.col("b.n").alias("best_n")), n)
    is_best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_key") == F.col("best_key"))
    kept = without_keys(docs, cut(rows.join(best, "root").where(~is_best).select("doc_id", "text_key"), n))
    repeated = cut(best.where("best_n > 1").select(F.col("best_id").alias("doc_id"), F.col("best_key").alias("text_key")), n)
    if repeated.isEmpty():
        return kept
    once = without_keys(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return without_keys(kept, repeated).unionByName(once)
