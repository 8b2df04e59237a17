"""Iceberg tables read by their own metadata: a snapshot, or the snapshots appended since another.

The table's JSON metadata names a manifest list, that names manifests, and these name data and delete files; the
Avro files are decoded in tasks, and only the list of files comes to the driver, as with any file scan.  Deletes
are anti-joins by position or by equality, later sequences over earlier data.  Columns are found by their field ids, so
renamed ones keep their values; tables whose files have none, which their name mapping tells, are read by name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ContractError
from sluice.sources.files import avro_records
from sluice.sources.tables import appended_snapshots, apply_equality_deletes, apply_position_deletes, select_snapshot
from sluice.storage import Folder

#: Data files up to which their sequence numbers are broadcast (some 200 bytes each).
BROADCAST_FILES = 200_000
_KINDS = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "uuid": T.StringType(), "binary": T.BinaryType()}


_ID = "parquet.field.id"


def _field(f: dict, by_id: bool) -> T.StructField:
    return T.StructField(f["name"], spark_type(f["type"], by_id), not f.get("required", False), {_ID: f["id"]} if by_id else None)


def spark_type(kind, by_id: bool = False) -> T.DataType:
    if isinstance(kind, str):
        if kind in _KINDS:
            return _KINDS[kind]
        if kind.startswith("decimal("):
            return T.DecimalType(*map(int, kind[8:-1].split(",")))
        if kind.startswith("fixed["):
            return T.BinaryType()
        raise ContractError(f"unknown type {kind}")
    if kind["type"] == "struct":
        return T.StructType([_field(f, by_id) for f in kind["fields"]])
    if kind["type"] == "list":
        return T.ArrayType(spark_type(kind["element"], by_id))
    return T.MapType(spark_type(kind["key"], by_id), spark_type(kind["value"], by_id))


@dataclass
class Table:
    """A table's metadata at one moment."""

    location: str
    metadata: dict

    @classmethod
    def open(cls, spark: SparkSession, location: str) -> "Table":
        """The newest metadata: what the version hint names, else the highest version there is."""
        folder = Folder(spark, f"{location.rstrip('/')}/metadata")
        names = [n for n, *_ in folder.list() if n.endswith(".metadata.json")]
        if folder.exists("version-hint.text"):
            hint = folder.read("version-hint.text").strip()
            names = [n for n in names if n in (f"v{hint}.metadata.json", f"{hint}.metadata.json", hint)] or names
        if not names:
            raise ContractError(f"{location} has no table metadata")
        newest = max(names, key=lambda n: (int("".join(c for c in n.split("-")[0].split(".")[0] if c.isdigit()) or 0), n))
        return cls(location.rstrip("/"), json.loads(folder.read(newest)))

    def snapshots(self) -> list[dict]:
        return [
            {"snapshot_id": s["snapshot-id"], "timestamp_ms": s["timestamp-ms"], "parent_id": s.get("parent-snapshot-id"), "operation": s.get("summary", {}).get("operation", "append"), "manifests": s["manifest-list"]}
            for s in self.metadata.get("snapshots", [])
        ]

    def select(self, **selector) -> int:
        refs = {k: v["snapshot-id"] for k, v in self.metadata.get("refs", {}).items()}
        return select_snapshot(self.snapshots(), current=self.metadata.get("current-snapshot-id"), refs=refs, **selector)

    def fields(self) -> list[dict]:
        if "schemas" in self.metadata:
            return next(s for s in self.metadata["schemas"] if s["schema-id"] == self.metadata["current-schema-id"])["fields"]
        return self.metadata["schema"]["fields"]

    def schema(self) -> T.StructType:
        return T.StructType([_field(f | {"required": False}, False) for f in self.fields()])

    def stored(self) -> T.StructType:
        """What files are asked for: each column by its id, under a name that no file has; or by its name."""
        if "schema.name-mapping.default" in self.metadata.get("properties", {}):
            return self.schema()
        return T.StructType([_field(f | {"required": False, "name": f"__field_{f['id']}"}, True) for f in self.fields()])


def _plain_path(path):
    """A path with one slash after its scheme, as Spark's file metadata has it."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+(?=[^/])", "$1:/")


def _entries(spark: SparkSession, table: Table, snapshot: dict) -> list:
    """(path, content, format, sequence, snapshot_id, equality ids) of a snapshot's live files."""

    def manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [(r["manifest_path"], r.get("sequence_number") or 0, r.get("added_snapshot_id")) for r in avro_records(data)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "sequence", "snapshot_id"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("manifest", pa.string()), ("path", pa.string()), ("content", pa.int32()), ("format", pa.string()), ("sequence", pa.int64()), ("snapshot_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for e in avro_records(data):
                    if e["status"] != 2:
                        f = e["data_file"]
                        rows.append({"manifest": name, "path": f["file_path"], "content": f.get("content") or 0, "format": f["file_format"], "sequence": e.get("sequence_number"), "snapshot_id": e.get("snapshot_id"), "ids": f.get("equality_ids")})
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    listed = spark.read.format("binaryFile").load(snapshot["manifests"]).select("content").mapInArrow(manifests, "path string, sequence long, snapshot_id long").collect()
    if not listed:
        return []
    by_path = {r["path"].split("://")[-1].lstrip("/").removeprefix("file:").lstrip("/"): r for r in listed}
    raw = spark.read.format("binaryFile").load([r["path"] for r in listed]).select("path", "content")
    found = raw.mapInArrow(files, "manifest string, path string, content int, format string, sequence long, snapshot_id long, ids array<int>").collect()
    out = []
    for r in found:
        own = by_path[r["manifest"].split("://")[-1].lstrip("/").removeprefix("file:").lstrip("/")]
        # an added file takes what its manifest was given when it was committed
        out.append((r["path"], r["content"], r["format"], own["sequence"] if r["sequence"] is None else r["sequence"], own["snapshot_id"] if r["snapshot_id"] is None else r["snapshot_id"], tuple(r["ids"] or ())))
    return out


def read_iceberg(spark: SparkSession, location: str, *, after: int | None = None, **selector) -> DataFrame:
    """The rows of a snapshot (``ref``, ``snapshot_id`` or ``as_of_ms``; the current one if none is named).

    With ``after`` only what appends added since that snapshot; anything but appends in between is an error.
    """
    table = Table.open(spark, location)
    snapshots = {s["snapshot_id"]: s for s in table.snapshots()}
    chosen = table.select(**selector)
    entries = _entries(spark, table, snapshots[chosen])
    if after is not None:
        wanted = set(appended_snapshots(table.snapshots(), after, chosen))
        entries = [e for e in entries if e[1] == 0 and e[4] in wanted]
    if bad := {e[2] for e in entries if e[2].lower() != "parquet"}:
        raise ContractError(f"files of format {sorted(bad)} are not read")
    schema = table.stored()
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")  # for schemas with field ids alone
    names = [F.col(f"`{f.name}`").alias(known.name, metadata={}) for f, known in zip(schema, table.schema())]
    data = [e for e in entries if e[1] == 0]
    if not data:
        return spark.createDataFrame([], schema).select(*names)
    rows = spark.read.schema(schema).parquet(*[e[0] for e in data])
    deletes = [e for e in entries if e[1] != 0]
    if not deletes:
        return rows.select(*names)
    sequences = spark.createDataFrame([(e[0], e[3]) for e in data], "__path string, _sequence bigint").withColumn("__path", _plain_path(F.col("__path")))
    if len(data) <= BROADCAST_FILES:
        sequences = F.broadcast(sequences)
    rows = rows.select("*", _plain_path(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_pos"))
    rows = rows.join(sequences, F.col("_file") == F.col("__path")).drop("__path")
    by_id = {f["id"]: stored.name for f, stored in zip(table.fields(), schema)}

    def read_deletes(group: list, columns: str | T.StructType) -> DataFrame:
        found = None
        for sequence in sorted({e[3] for e in group}):
            part = spark.read.schema(columns).parquet(*[e[0] for e in group if e[3] == sequence]).withColumn("sequence", F.lit(sequence).cast("bigint"))
            found = part if found is None else found.unionByName(part)
        return found

    if positions := [e for e in deletes if e[1] == 1]:
        gone = read_deletes(positions, "file_path string, pos bigint").select(_plain_path(F.col("file_path")).alias("file"), "pos", "sequence")
        rows = apply_position_deletes(rows, gone)
    for ids in sorted({e[5] for e in deletes if e[1] == 2}):
        keys = [by_id[i] for i in ids]
        gone = read_deletes([e for e in deletes if e[1] == 2 and e[5] == ids], T.StructType([schema[k] for k in keys]))
        rows = apply_equality_deletes(rows, gone, keys)
    return rows.select(*names)
