"""Watermarks per partition of the source, and rows that come after them.

The global watermark is the least over the partitions, waits while one has no claim, and never
goes back.  Rows are late against the *committed* watermark, so a rerun decides alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.errors import ContractError, PositionError

ACTIONS = ("quarantine", "recapture_next_epoch", "admit_with_annotation")
LATE = "_late"
_DOMAINS = ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz")


def partition_watermarks(df: DataFrame, partition: str, event_time: str) -> DataFrame:
    """The greatest event time of each source partition; null where it has none."""
    return df.groupBy(partition).agg(F.max(event_time).alias("watermark"))


def global_watermark(claims: DataFrame, previous=None, idle: tuple = ()) -> DataFrame:
    """One row: the least watermark of the partitions, or the previous one while any lacks a claim.

    ``idle`` partitions are left out, which only the source's own evidence allows.
    """
    keys = [c for c in claims.columns if c != "watermark"]
    rows = claims.where(~F.col(keys[0]).isin(*idle)) if idle else claims
    kind = claims.schema["watermark"].dataType
    before = F.lit(previous).cast(kind)
    ready = (F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count("watermark"))
    low = F.when(ready, F.min("watermark"))
    return rows.agg(F.coalesce(F.greatest(low, before), before).alias("watermark"))


def advance(before: DataFrame, claims: DataFrame) -> DataFrame:
    """New per-partition claims over old ones; a claim that goes back is an error."""
    key = [c for c in claims.columns if c != "watermark"][0]
    both = claims.join(before.select(key, F.col("watermark").alias("old")), key, "full_outer")
    back = F.raise_error(F.concat(F.lit("watermark went back in "), F.col(key).cast("string")))
    kind = claims.schema["watermark"].dataType
    return both.select(key, F.when(F.col("watermark") < F.col("old"), back.cast(kind)).otherwise(F.coalesce("watermark", "old")).alias("watermark"))


def _checked(df: DataFrame, event_time: str) -> None:
    kind = df.schema[event_time].dataType.simpleString()
    if kind not in _DOMAINS and not kind.startswith("decimal"):
        raise ContractError(f"{event_time} of type {kind} is no event time")


def is_late(event_time: str, watermark) -> Column:
    """Strictly before the watermark; null is not late, and nothing is before there is a watermark."""
    return F.coalesce(F.col(event_time) < F.lit(watermark), F.lit(False))


class LateSplit:
    """Rows by where they go; what nobody asks for is not even planned."""

    def __init__(self, admitted: DataFrame, quarantined: DataFrame | None = None, carried: DataFrame | None = None) -> None:
        self.admitted, self._quarantined, self._carried, self._none = admitted, quarantined, carried, admitted

    @property
    def quarantined(self) -> DataFrame:
        return self._none.where(F.lit(False)) if self._quarantined is None else self._quarantined

    @property
    def carried(self) -> DataFrame:
        return self._none.where(F.lit(False)) if self._carried is None else self._carried


def split_late(df: DataFrame, event_time: str, watermark, action: str = "quarantine") -> LateSplit:
    """Each row goes one way: admitted, quarantined or carried into the next epoch."""
    if action not in ACTIONS:
        raise ContractError(f"unknown late-data action {action}")
    _checked(df, event_time)
    if action == "admit_with_annotation":
        none = df.where(F.lit(False))
        return LateSplit(df.withColumn(LATE, is_late(event_time, watermark)), none, none)
    late, on_time = df.where(is_late(event_time, watermark)), df.where(~is_late(event_time, watermark))
    none = df.where(F.lit(False))
    return LateSplit(on_time, late, none) if action == "quarantine" else LateSplit(on_time, none, late)


def survives(outputs: tuple[tuple[str, tuple], ...] | None, event_time: str) -> str:
    """What a projection does to event time: preserve, transform or drop."""
    if outputs is None:
        return "preserve"
    for name, tree in outputs:
        if name == event_time:
            return "preserve" if tree == ("col", event_time) else "transform"
    return "drop"


def require_event_time(outputs, event_time: str) -> None:
    if survives(outputs, event_time) != "preserve":
        raise PositionError(f"{event_time} must pass through unchanged for its watermark to hold")
