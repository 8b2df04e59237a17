"""Transforms that contracts declare, applied one after the other: later ones see earlier ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ContractError
from sluice.functions import library
from sluice.functions.expressions import declared, filter_rows, scalar
from sluice.operators.contract import redacted
from sluice.operators.schema import reconcile_type


@dataclass(frozen=True)
class Derive:
    column: str
    expression: object  # SQL text, or a declared call tree


@dataclass(frozen=True)
class Filter:
    expression: object


@dataclass(frozen=True)
class Rename:
    old: str
    new: str


@dataclass(frozen=True)
class Cast:
    column: str
    to: str
    lossy_allowed: bool = False


@dataclass(frozen=True)
class Redact:
    column: str
    decision: str


@dataclass(frozen=True)
class ExpandNested:
    """``keep``, ``variant`` (JSON text) or ``child`` (one row per element: an extension)."""

    column: str
    policy: str = "keep"


def _column(expression, df: DataFrame):
    return scalar(expression, df) if isinstance(expression, str) else declared(expression)


def apply_transforms(df: DataFrame, transforms) -> DataFrame:
    for t in transforms:
        if not isinstance(t, (Derive, Filter, Rename)) and t.column not in df.columns:
            raise ContractError(f"no column {t.column}")
        match t:
            case Derive(column, expression):
                df = df.withColumn(column, _column(expression, df))
            case Filter(expression):
                df = filter_rows(df, _column(expression, df))
            case Rename(old, new):
                if old not in df.columns or new in df.columns:
                    raise ContractError(f"{old} cannot become {new}")
                df = df.withColumnRenamed(old, new)
            case Cast(column, to, lossy):
                kind = library.type_name(to)
                want = df.select(F.col(column).try_cast(kind).alias("x")).schema[0].dataType
                decision, _ = reconcile_type(df.schema[column].dataType, want)
                if decision == "unsupported" or (decision == "lossy_rejected" and not lossy):
                    raise ContractError(f"{column} as {to} is {decision}")
                df = df.withColumn(column, F.col(column).cast(kind))
            case Redact(column, decision):
                df = df.withColumn(column, redacted(F.col(f"`{column}`"), decision))
            case ExpandNested(column, policy):
                df = _expand(df, column, policy)
            case _:
                raise ContractError(f"unknown transform {t!r}")
    return df


def _expand(df: DataFrame, column: str, policy: str) -> DataFrame:
    kind = df.schema[column].dataType
    if policy == "keep":
        return df
    if policy == "variant":
        return df.withColumn(column, F.to_json(F.col(column)))
    if policy == "child" and isinstance(kind, T.ArrayType):
        return df.select("*", F.posexplode_outer(column).alias("_ordinal_in_parent", "_child")).drop(column)
    raise ContractError(f"{column}: no expansion {policy} of {kind.simpleString()}")
