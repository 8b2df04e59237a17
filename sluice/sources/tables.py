"""Table formats: row deletes over snapshots, partition pruning, change streams, package replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.errors import ContractError


def select_snapshot(snapshots: list[dict], *, current: int | None = None, refs: dict[str, int] | None = None, ref: str | None = None, snapshot_id: int | None = None, as_of_ms: int | None = None) -> int:
    """The snapshot that a selector names: an id, a branch or tag, the last at or before a time, or the current one."""
    known = {s["snapshot_id"]: s for s in snapshots}
    if sum(x is not None for x in (ref, snapshot_id, as_of_ms)) > 1:
        raise ContractError("select by one of ref, snapshot_id and as_of_ms")
    if ref is not None:
        if ref not in (refs or {}):
            raise ContractError(f"no branch or tag {ref}")
        return refs[ref]
    if snapshot_id is not None:
        if snapshot_id not in known:
            raise ContractError(f"no snapshot {snapshot_id}")
        return snapshot_id
    if as_of_ms is not None:
        before = [s for s in snapshots if s["timestamp_ms"] <= as_of_ms]
        if not before:
            raise ContractError("no snapshot is that old")
        return max(before, key=lambda s: s["timestamp_ms"])["snapshot_id"]
    if current not in known:
        raise ContractError("the table has no current snapshot")
    return current


def appended_snapshots(snapshots: list[dict], after: int, upto: int) -> list[int]:
    """Snapshots after one and up to another along the parents; anything but appends between them is an error."""
    known = {s["snapshot_id"]: s for s in snapshots}
    out, at = [], upto
    while at != after:
        if at not in known:
            raise ContractError(f"{after} is no ancestor of {upto}")
        if known[at].get("operation", "append") != "append":
            raise ContractError(f"snapshot {at} is not an append")
        out.append(at)
        at = known[at].get("parent_id")
    return out[::-1]


def apply_position_deletes(data: DataFrame, deletes: DataFrame) -> DataFrame:
    """Data rows (_file, _pos, _sequence, ...) without those that (file, pos, sequence) deletes of their time or later name."""
    d = deletes.groupBy("file", "pos").agg(F.max("sequence").alias("__sequence"))
    on = (data["_file"] == d["file"]) & (data["_pos"] == d["pos"]) & (data["_sequence"] <= d["__sequence"])
    return data.join(d, on, "left_anti")


def apply_equality_deletes(data: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Data rows without those that equal a delete of a later sequence; nulls are equal."""
    d = deletes.groupBy(*keys).agg(F.max("sequence").alias("__sequence")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__sequence")
    on = data["_sequence"] < d["__sequence"]
    for k in keys:
        on = on & data[k].eqNullSafe(d[f"__{k}"])
    return data.join(d, on, "left_anti")


def read_partitioned(spark: SparkSession, root: str, fmt: str = "parquet", where: str | None = None) -> DataFrame:
    """A hive-style table; a predicate on partition columns prunes folders before any file is opened."""
    df = spark.read.format(fmt).load(root)
    return df.where(where) if where else df


def read_catalog_table(spark: SparkSession, name: str, where: str | None = None) -> DataFrame:
    """A table of the session's catalog by name, location and format from there; partition predicates prune as above."""
    if not spark.catalog.tableExists(name):
        raise ContractError(f"no table {name} in the catalog")
    df = spark.read.table(name)
    return df.where(where) if where else df


def flatten_change_stream(events: DataFrame, document_schema: str, key: str = "_id") -> DataFrame:
    """Change events (JSON texts in ``event``) as rows: op, resume_token, the document's columns.

    Inserts, updates and replaces carry the whole document; deletes its key; anything else ends the stream and is an error.
    """
    kind = "operationType string, _id string, fullDocument string, documentKey string, clusterTime string"
    e = events.select(F.from_json("event", kind).alias("e")).select("e.*")
    known = F.when(F.col("operationType") == "replace", "update").when(F.col("operationType").isin("insert", "update", "delete"), F.col("operationType"))
    op = F.coalesce(known, F.raise_error(F.concat(F.lit("change stream event "), F.coalesce("operationType", F.lit("null")))))
    body = F.from_json(F.coalesce(F.when(F.col("operationType") != "delete", F.col("fullDocument")), F.col("documentKey")), document_schema)
    return e.select(op.alias("op"), F.col("_id").alias("resume_token"), body.alias("d")).select("op", "resume_token", "d.*")


def replay(spark: SparkSession, package_path: str) -> DataFrame:
    """The segments of a finished package; one without a manifest was never finished and is refused."""
    from sluice.sinks.package import read_segments
    from sluice.storage import Folder

    if not Folder(spark, package_path).exists("manifest.json"):
        raise ContractError(f"{package_path} has no manifest")
    return read_segments(spark, package_path.rstrip("/"))
