"""Best-fit packing of token sequences, improved by swaps between underfull bins.

Lengths are whole numbers up to ``capacity``, so the packing is worked out on the
histogram of lengths, whose size does not grow with the data: bins of equal content
are one *pattern* with a count.  Best-fit decreasing gives the first patterns; a local
search then moves or exchanges pieces (one for one, two for one) between underfull
bins, each step raising the sum of squared fills, until bins empty.  Pieces find
their place by their rank among the pieces of their length: the number of the partition that
encoded them and their count within it, so that no length, text or id gathers rows in one task.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sluice.llm.common import cut, if_small, slices
from sluice.llm.encoding import Encoder

CAPACITY = 1024
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, within long"


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, also: tuple[str, ...] = ()
) -> DataFrame:
    """The pieces of every whole text: ids and ``end_id``, cut only beyond ``capacity``.

    ``part`` is the partition and ``within`` counts its pieces of one length from 0.  The columns ``also``
    of a document follow with each of its pieces, as ``also_0`` and so on.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    tail = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            rows: list[int] = []
            for row, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ids = encoder.ids(text or "") + tail
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at) % capacity or capacity
                    crc = zlib.crc32(ids[4 * at : 4 * (at + length)])
                    for column, value in zip(out, (doc_id, piece, at, length, crc, part, seen[length])):
                        column.append(value)
                    rows.append(row)
                    seen[length] += 1
                    at += length
                    piece += 1
            if out[0]:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                carried = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types)), *carried], names)

    carried_as = _carried(also)
    names = [*(c.split()[0] for c in PIECES.split(", ")), *carried_as]
    types = [docs.schema[c].dataType.simpleString() for c in also]
    return docs.select("doc_id", "text", *also).mapInArrow(run, ", ".join([PIECES, *map(" ".join, zip(carried_as, types))]))


def _carried(also: tuple[str, ...]) -> list[str]:
    return [f"also_{k}" for k in range(len(also))]


class _Sizes:
    """Remaining counts by length, with the largest remaining length at or below a bound."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.count = [0] * (capacity + 1)
        for size, n in counts.items():
            self.count[size] = n
        self.below = list(range(capacity + 1))

    def largest(self, bound: int) -> int:
        at = bound
        while at and not self.count[at]:
            at = self.below[at] = self.below[at] - 1 if self.below[at] == at else self.below[at]
        x = bound
        while x and self.below[x] != x and x != at:
            self.below[x], x = at, self.below[x]
        return at


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Counter:
    """Patterns (sorted tuples of lengths, largest first) and how often each is packed."""
    sizes, patterns = _Sizes(counts, capacity), Counter()
    while first := sizes.largest(capacity):
        content: list[int] = []
        room, size = capacity, first
        while size:
            take = min(room // size, sizes.count[size] - content.count(size))
            if not take:
                size = _next(sizes, size - 1, content, room)
                continue
            content += [size] * take
            room -= size * take
            size = _next(sizes, min(room, size - 1), content, room)
        need = Counter(content)
        times = min(sizes.count[s] // k for s, k in need.items())
        for s, k in need.items():
            sizes.count[s] -= k * times
        patterns[tuple(content)] += times
    return patterns


def _next(sizes: _Sizes, bound: int, content: list[int], room: int) -> int:
    return sizes.largest(min(bound, room)) if min(bound, room) > 0 else 0


def improve_by_swaps(patterns: Counter, capacity: int) -> Counter:
    """Exchange pieces between underfull bins so that the sum of squared fills rises.

    Bins of one pattern are handled together.  A step takes the emptiest pattern and
    gives its pieces to fuller bins: as a move where they fit, else against one smaller
    piece (one for one), or against one smaller piece for two.  The fuller bin becomes fuller
    each time, so the sum of squares rises and the search ends; it stops when no step is left,
    or when the sum of lengths proves the count of bins least.
    """
    patterns = Counter(patterns)
    total = sum(sum(p) * n for p, n in patterns.items())
    least, bins = -(-total // capacity), sum(patterns.values())
    gifts = {p: _gifts(p) for p in patterns if sum(p) < capacity}
    waiting = [(sum(p), p) for p in gifts]
    heapq.heapify(waiting)
    tried: set[tuple[int, ...]] = set()
    while bins > least and waiting:
        donor = heapq.heappop(waiting)[1]
        if donor not in gifts or donor in tried:
            continue
        step = _better(donor, gifts[donor], gifts, patterns, capacity)
        if step is None:
            tried.add(donor)
            continue
        target, new_donor, new_target = step
        times = patterns[donor] // 2 if target == donor else min(patterns[donor], patterns[target])
        for old in (donor, target):
            patterns[old] -= times
        changed = [p for p in (new_donor, new_target) if p]
        for new in changed:
            patterns[new] += times
        bins -= times * (not new_donor)
        for old in {donor, target}:
            if not patterns[old]:
                del patterns[old], gifts[old]
                tried.discard(old)
        underfull = [p for p in changed if sum(p) < capacity]
        for new in underfull:
            if new not in gifts:
                gifts[new] = _gifts(new)
        # a pattern without a step can only have got one with the bins that are new
        again = {p for p in tried if p in underfull or _better(p, gifts[p], underfull, patterns, capacity)}
        tried -= again
        for p in {*again, *underfull, *(p for p in (donor, target) if p in gifts)}:
            heapq.heappush(waiting, (sum(p), p))
    return patterns


def _better(donor: tuple[int, ...], gifts: tuple, targets: Iterable[tuple[int, ...]], patterns: Counter, capacity: int) -> tuple | None:
    """The step from ``donor`` to one of ``targets`` that fills most."""
    sums, gives = gifts
    fill, best, found = sum(donor), 0, None
    for target in targets:
        room = capacity - (full := sum(target))
        if room <= best or full < fill or (target == donor and patterns[donor] < 2):
            continue
        for back in (0, *sorted(set(target), reverse=True)):
            at = bisect_right(sums, room + back) - 1
            if at >= 0 and sums[at] - back > best:
                best, found = sums[at] - back, (target, gives[at], back)
    if found is None:
        return None
    target, give, back = found
    left, kept = list(donor), list(target)
    for x in give:
        left.remove(x)
    if back:
        kept.remove(back)
        left.append(back)
    return target, tuple(sorted(left, reverse=True)), tuple(sorted([*kept, *give], reverse=True))


def _gifts(donor: tuple[int, ...]) -> tuple[list[int], list[tuple[int, ...]]]:
    """What one piece or two of a bin sum to, rising, and for each sum the pieces, one rather than two."""
    counts = sorted(Counter(donor).items(), reverse=True)
    found = {x + y: (x, y) for i, (x, n) in enumerate(counts) for y, _ in counts[i + (n < 2) :]}
    found |= {x: (x,) for x, _ in counts}
    sums = sorted(found)
    return sums, [found[s] for s in sums]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Counter:
    return improve_by_swaps(best_fit_decreasing(counts, capacity), capacity)


def _places(patterns: Counter) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first bin, pieces a bin and offset of the first, for each pattern in turn."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    base = 0
    for content, n in sorted(patterns.items(), reverse=True):
        at = 0
        for size, k in sorted(Counter(content).items(), reverse=True):
            rows.setdefault(size, []).append((seen[size], base, k, at))
            seen[size] += n * k
            at += size * k
        base += n
    return {size: tuple(np.array(c, np.int64) for c in zip(*r)) for size, r in rows.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, also: tuple[str, ...] = ()) -> DataFrame:
    """Add sequence_id and offset to the rows of ``token_pieces``, which must be materialised; ``also`` comes last.

    Only the histogram of lengths (at most ``capacity`` rows) comes to the driver.
    """
    # a row for each length and partition at most
    most = pieces.rdd.getNumPartitions() * capacity
    by_part = cut(pieces.groupBy("length", "part").count(), most)
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = _places(plan_bins(counts, capacity))
    # a length has one row a partition here
    before = F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    first = cut(by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("first")), most)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(if_small(first), ["length", "part"]).select(*names, (F.col("first") + F.col("within")).alias("rank"), *_carried(also))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                firsts, bases, each, starts = places[size]
                p = np.searchsorted(firsts, ranks[at], side="right") - 1
                inner = ranks[at] - firsts[p]
                bins[at] = bases[p] + inner // each[p]
                offsets[at] = starts[p] + inner % each[p] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets), *batch.columns[6:]], [*names, "sequence_id", "offset", *also])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    types = [pieces.schema[c].dataType.simpleString() for c in _carried(also)]
    return ranked.mapInArrow(place, ", ".join([out, *(f"`{c}` {t}" for c, t in zip(also, types))]))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, also: tuple[str, ...] = ()) -> DataFrame:
    """Pack all ``docs`` into sequences of at most ``capacity`` tokens; one row per piece.

    A null or empty text is the end token alone; repeated rows are packed each; a null
    doc_id stays null.  A text beyond ``capacity`` tokens is cut into full pieces, of which the
    first may be shorter.  An empty table gives no rows.  The columns ``also`` follow, as the document has
    them, under names that no result has; others are not read.
    """
    return pack_pieces(cut(token_pieces(docs, tokenizer, capacity, also=also)), capacity, also)
