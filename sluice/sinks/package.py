"""Packages: the immutable evidence of one run, a folder of segments, statistics, quarantine and a manifest.

The package hash covers the schema and the rows as a set, whatever tasks wrote them: two
independent 64-bit hashes of each row are summed, in one pass over what was written.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import DeliveryError
from sluice.operators.schema import fingerprint
from sluice.operators.segments import TARGET_ROWS, with_folder, with_ordinal, with_segment
from sluice.operators.statistics import profile, segment_and_package
from sluice.storage import Folder

# fixed values: the stages of a package's life, in order
STATUSES = ("planned", "extracting", "validated", "packaged", "loading", "loaded", "committed", "checkpointed", "archived")
_FOLDER = "__first_segment"


@dataclass(frozen=True)
class Package:
    path: str
    package_id: str
    package_hash: str
    schema_hash: str
    row_count: int


def _row_hashes(schema: T.StructType) -> list[Column]:
    """Aggregates a, b and n: two sums of row hashes, and the rows."""
    columns = [F.col(f"`{f.name}`") if f.dataType.typeName() != "map" else F.array_sort(F.map_entries(f"`{f.name}`")) for f in schema]
    shapes = [c.cast("string") if f.dataType.typeName() == "variant" else c for c, f in zip(columns, schema)]
    marks = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    a = F.xxhash64(F.lit(1), marks, *shapes).cast("decimal(38,0)")
    b = F.xxhash64(F.lit(2), *shapes[::-1], marks).cast("decimal(38,0)")
    return [F.sum(a).alias("a"), F.sum(b).alias("b"), F.count(F.lit(1)).alias("n")]


def _digest(schema: T.StructType, sums) -> tuple[str, int]:
    text = f"{schema.simpleString()}|{sums['a'] or 0}|{sums['b'] or 0}|{sums['n']}"
    return hashlib.sha256(text.encode()).hexdigest(), sums["n"]


def content_hash(df: DataFrame) -> tuple[str, int]:
    """(hash of names, types and rows, row count), the same for any order and partitioning."""
    return _digest(df.schema, df.agg(*_row_hashes(df.schema)).first().asDict())


def read_segments(spark: SparkSession, base: str) -> DataFrame:
    """The segments of the package in a folder, with ``_segment`` if they are numbered."""
    return spark.read.parquet(f"{base}/segments").drop(_FOLDER)


class Packages:
    """Packages under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)

    def build(
        self, package_id: str, rows: DataFrame, quarantine: DataFrame | None = None, order_by: Sequence[str] = (), target_rows: int = TARGET_ROWS, statistics: bool = False, lineage: Sequence[dict] = ()
    ) -> Package:
        """Write a package; the manifest comes last, so a package without one was never finished.

        With ``order_by`` rows are numbered in that order and cut into segments of ``target_rows``, which their column
        ``_segment`` tells; small ones that follow each other share a folder when there are many.  Without, each task's
        files are its segments and no shuffle is needed.
        """
        if self.folder.exists(f"{package_id}/manifest.json"):
            return self.open(package_id)
        self.folder.delete(package_id)
        base = f"{self.root}/{package_id}"
        out = rows
        if order_by:
            numbered = with_segment(with_ordinal(rows, order_by, total="_total"), target_rows)
            foldered = with_folder(numbered, "_total", target_rows, name=_FOLDER)
            out = foldered.sortWithinPartitions(_FOLDER, "_ordinal").drop("_ordinal", "_total")  # the order in which folders are written
        seen = Observation()
        writer = out.observe(seen, *_row_hashes(rows.schema)).write.option("compression", "zstd")  # hashed by the tasks that write
        if order_by:
            writer.partitionBy(_FOLDER).parquet(f"{base}/segments")
        else:
            writer.option("maxRecordsPerFile", target_rows).parquet(f"{base}/segments")
        if statistics:
            written = read_segments(self.spark, base)
            stats = segment_and_package(written, "_segment") if order_by else profile(written.select(*rows.columns))
            stats.write.parquet(f"{base}/statistics")
        quarantined = 0
        if quarantine is not None:
            counted = Observation()
            quarantine.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/quarantine")
            quarantined = counted.get["n"]
        digest, n = _digest(rows.schema, seen.get)
        manifest = {
            "package_id": package_id, "package_hash": digest, "schema_hash": fingerprint(rows.schema), "schema": json.loads(rows.schema.json()), "row_count": n,
            "quarantined": quarantined, "status": "packaged", "segments": self._segments(package_id), "lineage": list(lineage),
        }
        manifest["segment_count"] = -(-n // target_rows) if order_by else len(manifest["segments"])
        self.folder.write(f"{package_id}/manifest.json", json.dumps(manifest, sort_keys=True))
        return Package(base, package_id, digest, manifest["schema_hash"], n)

    def _segments(self, package_id: str) -> list[dict]:
        """(path, bytes) of the segment files: metadata, one entry a file."""
        found = []
        for name, size, _, is_dir in self.folder.list(f"{package_id}/segments"):
            if is_dir:
                found += [{"path": f"segments/{name}/{n}", "byte_count": s} for n, s, *_ in self.folder.list(f"{package_id}/segments/{name}") if n.endswith(".parquet")]
            elif name.endswith(".parquet"):
                found.append({"path": f"segments/{name}", "byte_count": size})
        return found

    def manifest(self, package_id: str) -> dict:
        return json.loads(self.folder.read(f"{package_id}/manifest.json"))

    def open(self, package_id: str) -> Package:
        m = self.manifest(package_id)
        return Package(f"{self.root}/{package_id}", package_id, m["package_hash"], m["schema_hash"], m["row_count"])

    def read(self, package_id: str) -> DataFrame:
        m = self.manifest(package_id)
        return self.spark.read.parquet(f"{self.root}/{package_id}/segments").select(*[f["name"] for f in m["schema"]["fields"]])

    def verify(self, package_id: str) -> Package:
        """Hash the rows again and hold them against the manifest."""
        digest, n = content_hash(self.read(package_id))
        m = self.manifest(package_id)
        if (digest, n) != (m["package_hash"], m["row_count"]):
            raise DeliveryError(f"{package_id} is not what its manifest says")
        return self.open(package_id)

    def set_status(self, package_id: str, status: str) -> None:
        """Move a package on; its life goes one way."""
        m = self.manifest(package_id)
        if STATUSES.index(status) < STATUSES.index(m["status"]):
            raise DeliveryError(f"{package_id} is {m['status']} and cannot become {status}")
        self.folder.write(f"{package_id}/manifest.json", json.dumps(m | {"status": status}, sort_keys=True), overwrite=True)

    def archive(self, package_id: str, to: str, compression: str = "zstd") -> dict:
        """Rewrite a package's rows elsewhere and report whether they are the same."""
        rows = self.read(package_id)
        rows.write.option("compression", compression).parquet(to)
        digest, n = content_hash(self.spark.read.parquet(to).select(*rows.columns))
        m = self.manifest(package_id)
        self.set_status(package_id, "archived")
        return {"package_id": package_id, "rows": n, "faithful": digest == m["package_hash"]}

    def all(self) -> list[dict]:
        return [self.manifest(n) for n, _, _, is_dir in self.folder.list() if is_dir and self.folder.exists(f"{n}/manifest.json")]
