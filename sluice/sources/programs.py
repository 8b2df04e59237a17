"""Sources that are code: Python resources, and programs that speak NDJSON, Singer or Airbyte."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ContractError


@dataclass(frozen=True)
class PythonResource:
    """A generator of dict rows or Arrow batches, one call for each of its partitions."""

    name: str
    fn: Callable[..., Iterable]
    schema: str
    partitions: tuple = (None,)
    primary_key: tuple[str, ...] = ()
    cursor: str | None = None
    disposition: str = "append"


def resource(schema: str, *, name: str | None = None, partitions: tuple = (None,), primary_key: tuple[str, ...] = (), cursor: str | None = None, disposition: str = "append"):
    """Make a generator function a resource; with partitions it is called with each in turn, in parallel."""

    def wrap(fn: Callable[..., Iterable]) -> PythonResource:
        return PythonResource(name or fn.__name__, fn, schema, partitions, primary_key, cursor, disposition)

    return wrap


#: Keys of other loaders' resource arguments and what they are called here; ``skip`` has no equivalent.
DLT_DISPOSITIONS = {"append": "append", "replace": "replace", "merge": "merge"}


def from_dlt(hints: dict, fn: Callable[..., Iterable], schema: str) -> PythonResource:
    """A resource from dlt-style hints: name, primary_key or merge_key, write_disposition, incremental cursor_path."""
    disposition = hints.get("write_disposition", "append")
    if disposition not in DLT_DISPOSITIONS:
        raise ContractError(f"write disposition {disposition} is not supported")
    key = hints.get("primary_key") or hints.get("merge_key") or ()
    cursor = hints.get("incremental", {}).get("cursor_path") if isinstance(hints.get("incremental"), dict) else None
    return PythonResource(hints.get("name", fn.__name__), fn, schema, (None,), (key,) if isinstance(key, str) else tuple(key), cursor, DLT_DISPOSITIONS[disposition])


def read_python(spark: SparkSession, source: PythonResource) -> DataFrame:
    """The rows of a Python resource; its partitions run in tasks, batch by batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(source.schema)
    want, parts, fn = to_arrow_schema(schema), source.partitions, source.fn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows: list[dict] = []
                for item in fn() if parts == (None,) else fn(parts[i]):
                    if isinstance(item, (pa.RecordBatch, pa.Table)):
                        for b in item.to_batches() if isinstance(item, pa.Table) else [item]:
                            yield b.select(want.names).cast(want)
                    else:
                        rows.append(item)
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_pylist(rows, schema=want)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=want)

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, schema)


def run_lines(spark: SparkSession, commands: list[str], timeout: int = 3600) -> DataFrame:
    """(command, value): what programs write to their output, a task for each; a program that fails fails its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                with subprocess.Popen(shlex.split(commands[i]), stdout=subprocess.PIPE, text=True) as program:
                    lines: list[str] = []
                    for line in program.stdout:
                        lines.append(line.rstrip("\n"))
                        if len(lines) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array([i] * len(lines)), pa.array(lines)], ["command", "value"])
                            lines = []
                    if program.wait(timeout):
                        raise ContractError(f"{commands[i]} ended with {program.returncode}")
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(lines)), pa.array(lines)], ["command", "value"])

    return spark.range(0, len(commands), 1, len(commands)).mapInArrow(run, "command long, value string")


def singer_records(lines: DataFrame, stream: str, schema: str) -> DataFrame:
    """Records of one stream of Singer messages."""
    message = F.from_json("value", "type string, stream string, record string")
    rows = lines.select(message.alias("m")).where((F.col("m.type") == "RECORD") & (F.col("m.stream") == stream))
    return rows.select(F.from_json("m.record", schema).alias("r")).select("r.*")


def singer_state(lines: DataFrame) -> DataFrame:
    """State messages as JSON texts."""
    message = F.from_json("value", "type string, value string")
    return lines.select(message.alias("m")).where(F.col("m.type") == "STATE").select(F.col("m.value").alias("state"))


def airbyte_records(lines: DataFrame, stream: str, schema: str) -> DataFrame:
    """Records of one stream of Airbyte messages."""
    message = F.from_json("value", "type string, record struct<stream:string,data:string,emitted_at:bigint>")
    rows = lines.select(message.alias("m")).where((F.col("m.type") == "RECORD") & (F.col("m.record.stream") == stream))
    return rows.select(F.from_json("m.record.data", schema).alias("r")).select("r.*")


def airbyte_state(lines: DataFrame) -> DataFrame:
    message = F.from_json("value", "type string, state string")
    return lines.select(message.alias("m")).where(F.col("m.type") == "STATE").select(F.col("m.state").alias("state"))


def ndjson_records(lines: DataFrame, schema: str) -> DataFrame:
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")
