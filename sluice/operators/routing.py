"""Rows to several targets by the value of one field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import DeliveryError

ROUTE = "_route"
_SCALARS = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def with_route(df: DataFrame, field: str) -> DataFrame:
    """Add the typed route of every row (whole number 1 and text "1" differ); null is an error."""
    kind = df.schema[field].dataType
    if not isinstance(kind, _SCALARS):
        raise DeliveryError(f"{field} of type {kind.simpleString()} is no route")
    value = F.col(f"`{field}`")
    name = F.concat(F.lit(kind.typeName() + ":"), value.cast("string"))
    return df.withColumn(ROUTE, F.when(value.isNull(), F.raise_error(F.lit(f"{field}: null has no route"))).otherwise(name))


def route_counts(df: DataFrame, field: str, max_targets: int) -> DataFrame:
    """(route, rows); more routes than ``max_targets`` fail.  At most ``max_targets`` + 1 rows come to the driver."""
    counts = with_route(df, field).groupBy(F.col(ROUTE).alias("route")).agg(F.count(F.lit(1)).alias("rows"))
    if len(counts.limit(max_targets + 1).collect()) > max_targets:
        raise DeliveryError(f"{field} has more than {max_targets} routes")
    return counts


def check_routes(df: DataFrame, field: str, known: list) -> None:
    """Fail before delivery if a row's value has no output."""
    if not df.where(F.col(field).isNull() | ~F.col(field).isin(*known)).isEmpty():
        raise DeliveryError(f"{field} has a value without an output")
