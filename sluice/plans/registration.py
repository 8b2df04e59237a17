"""The queries of the engine by name, and the SQL that each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from sluice.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL for the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the storage that driver and executors share."""
    return f"{shared_folder(spark)}/sluice-{uuid.uuid4().hex}"


def decisions(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of what a rule decides: one row a case, whatever the data."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def outcome(call: Callable[[], object]) -> str:
    """``ok``, or the kind of error with which a call is refused."""
    from sluice.errors import SluiceError

    try:
        call()
    except SluiceError as e:
        return type(e).__name__
    return "ok"


def values(rows: Sequence[tuple], columns: str) -> str:
    """SQL for literal rows."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"
