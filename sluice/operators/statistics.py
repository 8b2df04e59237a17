"""Column statistics at segment and package grain, their merge, and pruning by them.

A profile is one aggregate over the data whatever the number of columns: partial sums in
each task, one row per segment after the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import AdmissionError
from sluice.functions.sqltext import parse_scalar

_FLOATS = (T.FloatType, T.DoubleType)
_BOUNDED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)

PROFILE = "column string, row_count bigint, null_count bigint, minimum string, maximum string, complete boolean"


def _aggregates(fields: Sequence[T.StructField], grouped: bool) -> list[Column]:
    """Counts, typed bounds, and whether nothing spoils them: NaN, infinity, or a type without an order.

    Text bounds by group would have Spark sort the rows; with an empty set beside them it hashes the groups.
    """
    rows = F.count(F.lit(1))
    if grouped and any(isinstance(f.dataType, T.StringType) for f in fields):
        rows = rows + F.size(F.collect_set(F.lit(None).cast("int")))
    out = [rows.alias("rows")]
    for i, f in enumerate(fields):
        value = F.col(f"`{f.name}`")
        bounded = isinstance(f.dataType, _BOUNDED)
        sound = F.lit(bounded)
        if isinstance(f.dataType, _FLOATS):
            sound = ~F.coalesce(F.bool_or(F.isnan(value) | value.isin(math.inf, -math.inf)), F.lit(False))
        out += [F.count(value).alias(f"n{i}"), F.min(value if bounded else F.lit(None)).alias(f"lo{i}"), F.max(value if bounded else F.lit(None)).alias(f"hi{i}"), sound.alias(f"ok{i}")]
    return out


def _tall(wide: DataFrame, fields: Sequence[T.StructField], by: Sequence[str]) -> DataFrame:
    parts = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
            F.when(F.col(f"ok{i}"), F.col(f"lo{i}").cast("string")).alias("minimum"),
            F.when(F.col(f"ok{i}"), F.col(f"hi{i}").cast("string")).alias("maximum"),
            F.col(f"ok{i}").alias("complete"),
        )
        for i, f in enumerate(fields)
    ]
    return wide.select(*by, F.explode(F.array(*parts)).alias("p")).select(*by, "p.*")


def _halves(df: DataFrame, by: Sequence[str]) -> list[list[T.StructField]]:
    """Texts apart from the rest, whose bounds stay in generated code; each half reads its own columns only."""
    fields = [f for f in df.schema if f.name not in by]
    texts = [f for f in fields if isinstance(f.dataType, T.StringType)]
    return [half for half in ([f for f in fields if f not in texts], texts) if half] or [[]]


def profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by`` columns and one row per column: counts, bounds as texts, and whether the bounds are complete."""
    return reduce(DataFrame.unionByName, [_tall(df.groupBy(*by).agg(*_aggregates(half, bool(by))), half, by) for half in _halves(df, by)])


def segment_and_package(df: DataFrame, segment: str) -> DataFrame:
    """Profiles of every segment and, with a null segment, of the package.

    Each column is read once; the package's profile comes from the segments' rows, one a segment.  One incomplete
    segment leaves the package without bounds.
    """
    parts = []
    for half in _halves(df, [segment]):
        wide = df.groupBy(segment).agg(*_aggregates(half, True))
        merged = [F.sum("rows").alias("rows")]
        for i in range(len(half)):
            merged += [F.sum(f"n{i}").alias(f"n{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"), F.bool_and(f"ok{i}").alias(f"ok{i}")]
        parts.append(_tall(wide.rollup(segment).agg(*merged), half, [segment]))
    return reduce(DataFrame.unionByName, parts)


def merge_profiles(profiles: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Stored profiles (PROFILE rows, any grain) joined to one row per column, in one pass.

    Counts add up; one incomplete part makes the whole incomplete, and its bounds go for good.
    """
    aggregates, parts = [], []
    for i, (column, kind) in enumerate(kinds.items()):
        own = F.col("column") == column
        aggregates += [
            F.sum(F.when(own, F.col("row_count"))).alias(f"r{i}"),
            F.sum(F.when(own, F.col("null_count"))).alias(f"n{i}"),
            F.min(F.when(own, F.col("minimum").try_cast(kind))).alias(f"lo{i}"),
            F.max(F.when(own, F.col("maximum").try_cast(kind))).alias(f"hi{i}"),
            F.bool_and(F.when(own, F.col("complete"))).alias(f"ok{i}"),
        ]
        parts.append(
            F.struct(
                F.lit(column).alias("column"),
                F.col(f"r{i}").alias("row_count"),
                F.col(f"n{i}").alias("null_count"),
                F.when(F.col(f"ok{i}"), F.col(f"lo{i}").cast("string")).alias("minimum"),
                F.when(F.col(f"ok{i}"), F.col(f"hi{i}").cast("string")).alias("maximum"),
                F.col(f"ok{i}").alias("complete"),
            )
        )
    return profiles.agg(*aggregates).select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("row_count is not null")


_NEGATED = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}
_FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _possible(tree: tuple, kinds: dict[str, str], negated: bool = False) -> tuple[Column, Column]:
    """(a row may satisfy the predicate, the answer rests on complete evidence), over columns p_<column>."""
    what = tree[0]
    if what == "op" and tree[1] in ("and", "or"):
        a, b = (_possible(t, kinds, negated) for t in tree[2:])
        both = (tree[1] == "and") != negated
        return (a[0] & b[0] if both else a[0] | b[0]), a[1] & b[1]
    if what == "unary" and tree[1] == "not":
        return _possible(tree[2], kinds, not negated)
    if what == "unary" and tree[1] in ("is_null", "is_not_null") and tree[2][0] == "col":
        p = F.col(f"`p_{tree[2][1]}`")
        nulls = (tree[1] == "is_null") != negated
        found = p["null_count"] > 0 if nulls else p["row_count"] > p["null_count"]
        return F.coalesce(found, F.lit(True)), p.isNotNull()
    if what == "op" and tree[1] in _NEGATED:
        op, a, b = tree[1], tree[2], tree[3]
        if a[0] == "lit" and b[0] == "col":
            op, a, b = _FLIP[op], b, a
        if a[0] == "col" and b[0] == "lit" and isinstance(a[1], str):
            if a[1] not in kinds:
                raise AdmissionError(f"no column {a[1]}")
            op = _NEGATED[op] if negated else op
            p, kind, value = F.col(f"`p_{a[1]}`"), kinds[a[1]], F.lit(b[1])
            low, high = p["minimum"].cast(kind), p["maximum"].cast(kind)
            known = F.coalesce(p["complete"], F.lit(False))
            some = F.coalesce(p["row_count"] > p["null_count"], F.lit(True))
            test = {
                "=": (low <= value) & (high >= value),
                "!=": ~((low == value) & (high == value)),
                "<": low < value,
                "<=": low <= value,
                ">": high > value,
                ">=": high >= value,
            }[op]
            return some & (~known | F.coalesce(test, F.lit(False) if b[1] is None else F.lit(True))), known
    raise AdmissionError("pruning takes comparisons of columns with literals, AND, OR, NOT and IS NULL")


def prune(profiles: DataFrame, segment: str, predicate: str, kinds: dict[str, str]) -> DataFrame:
    """(segment, outcome): pruned, retained_may_match or retained_conservatively.

    A segment goes only where complete statistics prove that no row can satisfy the predicate.  Only metadata is
    touched: one row per segment and column.
    """
    tree = parse_scalar(predicate)
    pivot = profiles.groupBy(segment).agg(
        *[F.first(F.when(F.col("column") == c, F.struct("row_count", "null_count", "minimum", "maximum", "complete")), ignorenulls=True).alias(f"p_{c}") for c in kinds]
    )
    may, known = _possible(tree, kinds)
    outcome = F.when(~may, "pruned").when(known, "retained_may_match").otherwise("retained_conservatively")
    return pivot.select(segment, outcome.alias("outcome"))
