"""Keyed deduplication and change reduction over an explicit package order.

Partition order means nothing in Spark, so every operator takes the columns of a total order.
Keys are compared with nulls equal; maps are compared as sorted entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sluice.errors import ContractError

_RANK = "__sluice_rank"


def comparable(name: str, kind: T.DataType) -> Column:
    """A column in a form that groups and sorts by value."""
    value = F.col(f"`{name}`")
    return F.array_sort(F.map_entries(value)) if isinstance(kind, T.MapType) else value


def _keys(df: DataFrame, names: Sequence[str]) -> list[Column]:
    kinds = {f.name: f.dataType for f in df.schema}
    if not names or len(set(names)) < len(names) or any(n not in kinds for n in names):
        raise ContractError(f"keys must be distinct columns: {list(names)}")
    return [comparable(n, kinds[n]) for n in names]


def _ordered(order_by: Sequence[str], descending: bool) -> list[Column]:
    if not order_by:
        raise ContractError("package order needs columns")
    return [F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c in order_by]


def keep_one(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], keep: str = "first") -> DataFrame:
    """The first or last row of each key in the order of ``order_by``; ``fail`` raises on any repeat."""
    if keep == "fail":
        refuse_repeats(df, keys)
        return df
    if keep not in ("first", "last"):
        raise ContractError(f"unknown keep: {keep}")
    order = _ordered(order_by, descending=keep == "last")
    ranked = df.withColumn(_RANK, F.row_number().over(W.partitionBy(*_keys(df, keys)).orderBy(*order)))
    return ranked.where(F.col(_RANK) == 1).drop(_RANK)


def refuse_repeats(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise before anything is delivered if two rows share a key."""
    names = [f"k{i}" for i in range(len(keys))]
    counted = df.select(*[k.alias(n) for k, n in zip(_keys(df, keys), names)]).groupBy(*names).count()
    if not counted.where("count > 1").isEmpty():
        raise ContractError(f"repeated key in {', '.join(keys)}")


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows, nulls equal."""
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    keys = [comparable(f.name, f.dataType).alias(f"k{i}") for i, f in enumerate(df.schema)]
    rows = df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return rows.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.first("row").alias("row")).select("row.*")


def dedup_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """input_rows, duplicate_key_count (keys of more than one row) and dropped_row_count."""
    names = [f"k{i}" for i in range(len(keys))]
    counts = df.select(*[k.alias(n) for k, n in zip(_keys(df, keys), names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("duplicate_key_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped_row_count"),
    )


def reduce_changes(changes: DataFrame, keys: Sequence[str], order_by: Sequence[str], route: str | None = None) -> DataFrame:
    """The last operation of each key, per route if there are routes."""
    scope = [*keys, route] if route else keys
    return keep_one(changes, scope, order_by, "last")


def split_changes(reduced: DataFrame, op: str = "op") -> tuple[DataFrame, DataFrame]:
    """(upserts, deletes) of reduced changes; an unknown operation fails the run."""
    known = F.col(op).isin("insert", "update", "delete")
    checked = reduced.withColumn(op, F.when(known, F.col(op)).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("null"))))))
    return checked.where(F.col(op) != "delete"), checked.where(F.col(op) == "delete")
