"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots.  Each block of the index posts
its vectors into one inverted file per pivot, with the pivot's place in their order; a query
goes through the files of its own nearest pivots, adds up how far places differ (Spearman's
footrule, places beyond the prefix counting as its end), and the best by footrule are ranked anew
by the exact inner product in double precision.  For the largest inner product, vectors get one more
component that brings them all to one length, which keeps the order of nearness.

The query set meets all rows in blocks: a task holds one block of queries and one of the
index, and hands on only its best rows for each query.  Posting lists that are keyed by pivot across the
cluster would shuffle every touched (query, vector) pair as a row instead; on vectors without structure, as
those at hand, a fifth of all pairs is touched before nine tenths of the nearest are among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PIVOTS = 256
#: Nearest pivots that represent a vector.
PREFIX = 64
NEIGHBOURS = 20
#: Share of a block that is ranked anew, and the least number of distinct vectors.
RERANK_SHARE = 0.1
RERANK_LEAST = 400
INDEX_BLOCK = 16_384
#: Bytes of query vectors, as doubles, that one task holds: the index is copied once for so many, so the block is as large as memory allows.
QUERY_BYTES = 32 << 20


def valid_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part.

    Null, empty and zero vectors, and those with a null or non-finite component, do not.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def choose_pivots(rows: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """``n`` vectors at most, drawn by a hash of their id from 4 n rows and then spread out."""
    drawn = rows.select("v", F.xxhash64("vec_id", F.lit("pivot")).alias("h")).orderBy("h").limit(4 * n).collect()
    return spread_out(np.array([r["v"] for r in drawn], np.float64), n)


def spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` distinct rows at most, each the one whose direction is farthest from those before."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < n:
        at = int(np.argmin(near))
        if near[at] > 1 - 1e-9:
            break
        chosen.append(at)
        near = np.maximum(near, unit @ unit[at])
    return x[chosen]


def _lengthened(x: np.ndarray, reach: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(reach * reach - (x * x).sum(axis=1), 0))
    return np.concatenate((x, rest[:, None]), axis=1)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the ``prefix`` nearest pivots of each row, nearest first, ties to the lower number."""
    near = x @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int32)


class PermutationIndex:
    """One block: distinct vectors, their ids and the inverted files of the pivots."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, reach: float, prefix: int, keep: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        rows = vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, which = np.unique(rows, return_index=True, return_inverse=True)
        # distinct vectors in the order of their smallest id; of equal ones the `keep` smallest ids can be among the nearest
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        which = rank[which]
        by_vector = np.argsort(which, kind="stable")
        again = np.zeros(len(ids), bool)
        again[1:] = (np.diff(which[by_vector]) == 0) & (np.diff(ids[by_vector]) == 0)
        by_vector = by_vector[~again]
        starts = np.searchsorted(which[by_vector], np.arange(len(first)))
        place = np.arange(len(by_vector)) - np.repeat(starts, np.diff(np.append(starts, len(by_vector))))
        by_vector = by_vector[place < keep]
        self.ids, self.of = ids[by_vector], which[by_vector]
        self.bounds = np.searchsorted(self.of, np.arange(len(first) + 1))
        self.vectors, self.prefix = vectors[np.sort(first)], min(prefix, len(pivots))
        self.pivots, self.reach = _lengthened(pivots, reach), reach
        lists = nearest_pivots(_lengthened(self.vectors, reach), self.pivots, self.prefix)
        flat = np.argsort(lists.ravel(), kind="stable")
        self.files = np.split(flat // self.prefix, np.searchsorted(lists.ravel()[flat], np.arange(1, len(pivots))))
        self.gains = np.split((self.prefix - flat % self.prefix).astype(np.int16), np.searchsorted(lists.ravel()[flat], np.arange(1, len(pivots))))

    def closeness(self, query_lists: np.ndarray) -> np.ndarray:
        """For one query, a number that falls as the footrule distance grows.

        With places cut at the prefix k, the footrule is a constant less twice the sum, over the
        pivots that both have, of k less the larger of the two places.
        """
        total = np.zeros(len(self.vectors), np.int32)
        for place, pivot in enumerate(query_lists.tolist()):
            total[self.files[pivot]] += np.minimum(self.gains[pivot], np.int16(self.prefix - place))
        return total

    def search(self, query_ids: np.ndarray, queries: np.ndarray, n: int, share: float, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query_id, ids, scores) of the ``n`` nearest found for each query, itself left out."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        lists = nearest_pivots(np.concatenate((unit, np.zeros((len(unit), 1))), axis=1), self.pivots, self.prefix)
        size = len(self.vectors)
        most = min(size, max(least, int(share * size)))
        asked = set()
        for query_id, query, own in zip(query_ids, queries, lists):
            if (same := (int(query_id), query.tobytes())) in asked:
                continue
            asked.add(same)
            # ties go to the vector with the smallest id
            key = self.closeness(own).astype(np.int64) * size - np.arange(size)
            found = np.argpartition(-key, most - 1)[:most] if most < size else np.arange(size)
            scores = self.vectors[found] @ query
            if len(found) > n + 1:
                edge = np.partition(scores, len(scores) - n - 1)[len(scores) - n - 1]
                found = found[scores >= edge]
            # summed the same way for every candidate, so that equal vectors have equal scores
            scores = np.array([float(np.dot(self.vectors[i], query)) for i in found])
            sizes = self.bounds[found + 1] - self.bounds[found]
            spots = np.concatenate([np.arange(self.bounds[i], self.bounds[i + 1]) for i in found]) if len(found) else np.zeros(0, np.int64)
            ids, scores = self.ids[spots], np.repeat(scores, sizes)
            other = ids != query_id
            ids, scores = ids[other], scores[other]
            best = np.lexsort((ids, -scores))[:n]
            yield query_id, ids[best], scores[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    vector: str = "embedding",
    n: int = NEIGHBOURS,
    prefix: int = PREFIX,
    share: float = RERANK_SHARE,
    least: int = RERANK_LEAST,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``n`` nearest rows of ``vectors`` found for each of ``queries``.

    Both have vec_id and ``vector``; a query's own vec_id is no candidate.  Vectors that are null, empty or zero or
    hold null or non-finite components take no part, nor do those whose number of components is not the most
    frequent one (ties: the larger), nor rows without an id.  Ties go to the smaller vec_id.  Repeated rows of one id and vector
    count once; other vectors under an id already taken are rows and queries of their own.  An empty table gives no rows, fewer candidates fewer rows; other columns are not read.
    """
    rows = valid_vectors(vectors, vector).where("vec_id is not null")
    facts = rows.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("reach")
    )
    widths = facts.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    width, count, reach = widths[0]["d"], widths[0]["n"], float(np.sqrt(widths[0]["reach"])) * (1 + 1e-12)
    rows = rows.where(F.size("v") == width)
    asked = valid_vectors(queries, vector).where(F.col("vec_id").isNotNull() & (F.size("v") == width))
    pivots = choose_pivots(rows)
    index_blocks, query_blocks = -(-count // INDEX_BLOCK), -(-max(1, asked.count()) // max(1, QUERY_BYTES // (8 * width)))

    def dealt(df: DataFrame, own: int, other: int, mine: str, theirs: str, is_query: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(own)).cast("int").alias(mine)
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs)
        return df.select(block, every, "vec_id", "v", F.lit(is_query).alias("q")).select("qb", "ib", "q", "vec_id", "v")

    cells = dealt(rows, index_blocks, query_blocks, "ib", "qb", False).unionByName(dealt(asked, query_blocks, index_blocks, "qb", "ib", True))
    names = ["query_id", "vec_id", "score"]

    def search(cell: pa.Table) -> pa.Table:
        is_query = cell.column("q").combine_chunks().to_numpy(zero_copy_only=False)
        ids, matrix = cell.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False), _matrix(cell.column("v"))
        out: list[list[np.ndarray]] = [[], [], []]
        if is_query.any() and not is_query.all():
            index = PermutationIndex(ids[~is_query], matrix[~is_query], pivots, reach, prefix, n + 1)
            for query_id, found, scores in index.search(ids[is_query], matrix[is_query], n, share, least):
                for column, value in zip(out, (np.full(len(found), query_id), found, scores)):
                    column.append(value)
        types = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(c).astype(t) if c else np.zeros(0, t)) for c, t in zip(out, types)], names)

    found = cells.groupBy("qb", "ib").applyInArrow(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("query_id", "rank", "vec_id", "score")
