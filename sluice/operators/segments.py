"""Package order, segments of a bounded size, limits in package order and stratified choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sluice.errors import ContractError
from sluice.storage import cut

TARGET_ROWS = 4_194_304
TARGET_BYTES = 256 << 20
# fixed value: up to this many segments have a folder each, beyond it small ones share theirs
FOLDERS = 128


def with_ordinal(df: DataFrame, order_by: Sequence[str], name: str = "_ordinal", total: str | None = None) -> DataFrame:
    """Number the rows from 0 in a total order, without bringing them into one task.

    Rows are dealt by range and sorted in their tasks; what is added to a task's numbers is the
    count of the ranges before it, one number per task.  A column ``total`` gets the count of all rows.
    """
    if not order_by:
        raise ContractError("package order needs columns")
    dealt = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    # task number and place in the task, fixed by the written copy: no second shuffle and no window
    dealt = cut(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    counts = dealt.groupBy(part).count()
    before = F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = [F.sum("count").over(W.partitionBy()).alias(total)] if total else []
    starts = counts.select(F.col("__part").alias("__of"), before.alias("__start"), *whole)  # a row for each task at most
    numbered = dealt.join(F.broadcast(starts), F.shiftright("__at", 33) == F.col("__of"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, (F.col("__start") + within).cast("bigint")).drop("__at", "__of", "__start")


def with_segment(ordered: DataFrame, target_rows: int = TARGET_ROWS, ordinal: str = "_ordinal", name: str = "_segment") -> DataFrame:
    """The segment of every numbered row, of ``target_rows`` rows each."""
    return ordered.withColumn(name, F.floor(F.col(ordinal) / target_rows).cast("bigint"))


def with_folder(rows: DataFrame, total: str, target_rows: int = TARGET_ROWS, folders: int = FOLDERS, segment: str = "_segment", name: str = "__first_segment") -> DataFrame:
    """The first segment of those that share a folder with the row's own, which follow each other.

    Files cost the driver time by their number, so that it has to grow with the rows and not with the segments.  Segments
    share no more than brings them down to ``folders``, and no more than ``TARGET_ROWS`` rows.
    """
    together = F.least(F.ceil(F.ceil(F.col(total) / target_rows) / folders), F.lit(max(1, TARGET_ROWS // target_rows)))
    return rows.withColumn(name, F.col(segment) - F.col(segment) % together)


def segments_by_bytes(sizes: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Segments of (batch, bytes) rows: a segment closes with the batch that brings it to the target."""
    before = F.coalesce(F.sum("bytes").over(W.orderBy("batch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("segment", F.floor(before / target_bytes).cast("bigint"))


def limit_in_order(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in package order; none opens no source."""
    if n < 0:
        raise ContractError("a limit is not negative")
    return df.limit(0) if n == 0 else df.orderBy(*order_by).limit(n)


def stratified(files: DataFrame, stratum: str, key: str, per_stratum: int, seed: int = 0) -> DataFrame:
    """The same ``per_stratum`` rows of each stratum every time: those of the least hashes."""
    order = W.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return files.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_stratum).drop("__r")
