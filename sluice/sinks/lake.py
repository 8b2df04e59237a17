"""Delivery into Parquet targets: append, replace, merge and change-apply under receipts.

A target is a row of numbered pointer objects; the last one names folders of Parquet files.  A load writes new folders and
then the next pointer, which must not be there yet, so readers see a load whole or not at all, a load that dies leaves only
unnamed folders, and of two writers one is told and loads again over the other's pointer.  The outputs of a routed target
share its pointer, so they change together.  Keyed targets are laid out in hash buckets of the key, as many as their
rows need: a merge reads and rewrites
the buckets that its keys fall into, and no others.  A package that has a receipt is never applied again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice.errors import DeliveryError
from sluice.operators.routing import ROUTE
from sluice.operators.schema import fingerprint
from sluice.plans.resource import DESTINATIONS, Delete
from sluice.storage import Folder, cut

#: Rows of a bucket.  A target that outgrows its buckets fourfold is laid out anew, so each row is moved a bounded number of times.
BUCKET_ROWS = 4_000_000
#: Rows and bytes of keys of a package up to which they are broadcast to the target's rows; beyond, both are shuffled.
BROADCAST_KEYS = 1_000_000
BROADCAST_BYTES = 32 << 20
#: Times that a load is made again because another writer was first.
ATTEMPTS = 3
_BUCKET = "__bucket"


@dataclass(frozen=True)
class Receipt:
    """What a destination acknowledges of one package."""

    receipt_id: str
    target: str
    disposition: str
    token: str
    schema_hash: str
    counts: dict = field(default_factory=dict)
    committed_at_ms: int = 0
    destination: str = "parquet"


def _buckets_for(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def _by_bucket(df: DataFrame) -> DataFrame:
    """Rows dealt by bucket, small ones together and large ones over several tasks."""
    return df.hint("rebalance", F.col(_BUCKET))


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class KeySize:
    rows: int
    bytes: int

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_KEYS and self.bytes <= BROADCAST_BYTES


def check_keys(stage: DataFrame, keys: Sequence[str]) -> KeySize:
    """The rows of a package whose merge keys are there, not null and unique, and the keys' bytes; else an error."""
    if missing := [k for k in keys if k not in stage.columns]:
        raise DeliveryError(f"merge key {missing} is not in the package")
    some_null = F.bool_or(F.greatest(*[F.col(f"`{k}`").isNull() for k in keys], F.lit(False)))
    size = sum((F.coalesce(F.octet_length(F.col(f"`{k}`").cast("string")), F.lit(0)) + 16 for k in keys), F.lit(0))
    counted = stage.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__size", size)
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = counted.agg(F.coalesce(some_null, F.lit(False)).alias("nulls"), zero(F.max("__n")).alias("most"), zero(F.sum("__n")).alias("rows"), zero(F.sum("__size")).alias("bytes")).first()
    if found["nulls"]:
        raise DeliveryError(f"null in the merge key {list(keys)}")
    if found["most"] > 1:
        raise DeliveryError(f"repeated merge key {list(keys)} in one package")
    return KeySize(found["rows"], found["bytes"])


def merged_rows(target: DataFrame, stage: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All rows after an upsert, with ``__change``: kept, updated or inserted.  One join on the key."""
    t = target.select(*columns, F.lit(1).alias("__t"))
    s = stage.select(*[F.col(f"`{c}`").alias(f"__s_{c}") for c in columns], F.lit(1).alias("__s"))
    on = [t[k].eqNullSafe(s[f"__s_{k}"]) for k in keys]
    both = t.join(s, on, "full_outer")
    change = F.when(F.col("__s").isNull(), "kept").when(F.col("__t").isNull(), "inserted").otherwise("updated")
    values = [F.when(F.col("__s").isNull(), F.col(f"`{c}`")).otherwise(F.col(f"`__s_{c}`")).alias(c) for c in columns]
    return both.select(*values, change.alias("__change"))


def applied_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], op: str, delete: Delete) -> DataFrame:
    """All rows after reduced changes, with ``__change``: kept, updated, inserted, hard_deleted, soft_deleted, missing_delete or ignored_delete.

    Rows marked hard_deleted and missing_delete are there to be counted and are not written.  ``changes`` has
    one row a key; upserts set a soft-delete marker back to false.
    """
    t = target.select(*columns, F.lit(1).alias("__t"))
    given = [c for c in columns if c in changes.columns]
    s = changes.select(*[F.col(f"`{c}`").alias(f"__s_{c}") for c in given], F.col(f"`{op}`").alias("__op"))
    both = t.join(s, [t[k].eqNullSafe(s[f"__s_{k}"]) for k in keys], "full_outer")
    gone, there = F.col("__op") == "delete", F.col("__t").isNotNull()
    if delete.policy == "ignore":
        deleted = F.when(there, "ignored_delete").otherwise("missing_delete")
    else:
        deleted = F.when(there, f"{delete.policy}_deleted").otherwise("missing_delete")
    change = F.when(F.col("__op").isNull(), "kept").when(gone, deleted).when(there, "updated").otherwise("inserted")
    values = []
    for c in columns:
        old = F.col(f"`{c}`")
        new = F.col(f"`__s_{c}`") if c in given else old
        if delete.policy == "soft" and c == delete.marker:
            values.append(F.when(F.col("__op").isNull(), old).otherwise(gone).alias(c))
        elif c in keys:
            values.append(F.coalesce(old, new).alias(c))
        else:
            values.append(F.when(F.col("__op").isNull() | gone, old).otherwise(new).alias(c))
    return both.select(*values, change.alias("__change"))


class Lake:
    """Targets, receipts and quarantine under one root folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)

    # -- pointers and receipts

    def _version(self, target: str) -> int:
        """The number of a target's last pointer, or 0."""
        return max((int(name.removesuffix(".json")) for name, *_ in self.folder.list(f"targets/{target}/pointers") if name.endswith(".json") and not name.startswith(".")), default=0)

    def _load(self, target: str, version: int) -> dict | None:
        return json.loads(self.folder.read(f"targets/{target}/pointers/{version:012d}.json")) if version else None

    def _pointer(self, target: str) -> dict | None:
        """The pointer in force of a target, or of an output of a routed one."""
        if (found := self._load(target, self._version(target))) is not None:
            return found
        routed, _, output = target.rpartition("/")
        found = self._load(routed, self._version(routed)) if routed else None
        return found["outputs"].get(output) if found and "outputs" in found else None

    def read(self, target: str) -> DataFrame | None:
        """The rows of a target, or None if it has never been loaded."""
        pointer = self._pointer(target)
        return None if pointer is None else self._rows(pointer, list(pointer["paths"].values()))

    def _rows(self, pointer: dict, paths: list) -> DataFrame:
        flat = [f"{self.root}/{p}" for ps in paths for p in ps]
        schema = self._schema(pointer)
        return self.spark.read.schema(schema).parquet(*flat) if flat else self.spark.createDataFrame([], schema)

    @staticmethod
    def _schema(pointer: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(pointer["schema"])

    def _publish(self, target: str, pointer: dict, version: int) -> bool:
        """Write the pointer of a number, unless another writer has."""
        name = f"targets/{target}/pointers/{version:012d}.json"
        if self.folder.exists(name):
            return False
        try:
            self.folder.write(name, json.dumps(pointer, sort_keys=True))
        except Py4JJavaError:
            if self.folder.exists(name):
                return False
            raise
        return True

    def receipt(self, target: str, token: str) -> Receipt | None:
        name = f"targets/{target}/receipts/{token}.json"
        return Receipt(**json.loads(self.folder.read(name))) if self.folder.exists(name) else None

    def receipts(self) -> list[Receipt]:
        """All receipts, those of routes included, in the order of their times."""
        found: list[Receipt] = []
        waiting = ["targets"]
        while waiting:
            at = waiting.pop()
            for name, _, _, is_dir in self.folder.list(at):
                if is_dir and name not in ("data", "pointers", "receipts"):
                    waiting.append(f"{at}/{name}")
                elif is_dir and name == "receipts":
                    found += [Receipt(**json.loads(self.folder.read(f"{at}/receipts/{n}"))) for n, *_ in self.folder.list(f"{at}/receipts") if n.endswith(".json")]
        return sorted(found, key=lambda r: (r.committed_at_ms, r.receipt_id))

    # -- loads

    def deliver(
        self, target: str, package: DataFrame, token: str, disposition: str, keys: Sequence[str] = (), delete: Delete = Delete(), op: str = "op", buckets: int | None = None
    ) -> Receipt:
        """Load one package and return its receipt; a token that has one gets the same receipt again."""
        if (known := self.receipt(target, token)) is not None:
            return known
        if disposition not in DESTINATIONS["parquet"].dispositions:
            raise DeliveryError(f"parquet does not take {disposition}")
        keyed = disposition in ("merge", "cdc_apply")
        if keyed:
            package = cut(package)
        for _ in range(ATTEMPTS):
            version = self._version(target)
            before = self._load(target, version)
            if before is not None and before.get("receipt", {}).get("token") == token:
                # an earlier run published the load and died before its receipt was written
                return self._acknowledge(Receipt(**before["receipt"]))
            if keyed:
                pointer, counts = self._keyed(target, before, package, keys, delete if disposition == "cdc_apply" else None, op, buckets)
            else:
                rows = self._write(package, path := self._new(target))
                pointer, counts = self._added(target, before if disposition == "append" else None, package, path, rows)
            receipt = self._receipt(target, disposition, token, package, counts)
            if self._publish(target, pointer | {"receipt": asdict(receipt)}, version + 1):
                return self._acknowledge(receipt)
        raise DeliveryError(f"other writers were first to {target} {ATTEMPTS} times")

    @staticmethod
    def _receipt(target: str, disposition: str, token: str, package: DataFrame, counts: dict) -> Receipt:
        return Receipt(uuid.uuid4().hex, target, disposition, token, fingerprint(package.schema), counts, int(time.time() * 1000))

    def _acknowledge(self, receipt: Receipt) -> Receipt:
        self.folder.write(f"targets/{receipt.target}/receipts/{receipt.token}.json", json.dumps(asdict(receipt), sort_keys=True))
        return receipt

    def _write(self, df: DataFrame, path: str) -> int:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        return seen.get["rows"]

    def _new(self, target: str) -> str:
        return f"targets/{target}/data/{uuid.uuid4().hex}"

    def _added(self, target: str, before: dict | None, package: DataFrame, path: str, rows: int) -> tuple[dict, dict]:
        """A pointer to what was there before and to a new folder."""
        pointer = before or {"schema": json.loads(package.schema.json()), "paths": {}, "keys": []}
        if [f.name for f in self._schema(pointer)] != package.columns:
            raise DeliveryError(f"{target} has other columns")
        paths = pointer["paths"] | {"": [*pointer["paths"].get("", []), path]}
        # rows without a bucket: the next merge lays the target out again
        return pointer | {"paths": paths, "keys": [], "rows": pointer.get("rows", 0) + rows}, {"kind": "rows", "rows_written": rows}

    def _keyed(self, target: str, pointer: dict | None, stage: DataFrame, keys: Sequence[str], delete: Delete | None, op: str, buckets: int | None) -> tuple[dict, dict]:
        """The pointer after a merge or applied changes; ``stage`` must be written already."""
        size = check_keys(stage, keys)
        total = size.rows
        columns = [c for c in stage.columns if delete is None or c != op]
        if delete is not None and delete.policy == "soft":
            if delete.marker not in columns:
                stage, columns = stage.withColumn(delete.marker, F.lit(False)), [*columns, delete.marker]
        pointer = pointer or {"schema": json.loads(stage.select(*columns).schema.json()), "paths": {}, "keys": list(keys), "rows": 0, "buckets": buckets or _buckets_for(total)}
        needed = _buckets_for(pointer["rows"] + total)
        if pointer["keys"] != list(keys) or needed > 4 * pointer["buckets"]:
            pointer = self._rebucketed(target, pointer, keys, max(buckets or 0, needed))
        pointer = pointer | {"paths": dict(pointer["paths"])}
        names = [f.name for f in self._schema(pointer)]
        if set(names) != set(columns):
            raise DeliveryError(f"{target} has other columns")
        n = pointer["buckets"]
        touched = sorted(r[0] for r in stage.select(_bucket(keys, n)).distinct().collect())  # a number for each bucket at most
        current = self._rows(pointer, [pointer["paths"].get(str(b), []) for b in touched])
        gone = F.lit(False) if delete is None else F.col(f"`{op}`") == "delete"
        small = size.small
        marks = stage.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], gone.alias("__gone"))
        on = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        marked = current.join(F.broadcast(marks) if small else marks, on, "left").withColumn(_BUCKET, _bucket(keys, n))
        if not small:
            marked = _by_bucket(marked)
        # counted in the stage that writes, whose tasks count once however often they are tried
        seen = Observation()
        matched = F.col("__gone").isNotNull()
        marked = marked.observe(seen, F.sum((matched & ~F.col("__gone")).cast("long")).alias("updated"), F.sum((matched & F.col("__gone")).cast("long")).alias("deleted"))
        policy = "none" if delete is None else delete.policy
        keep = ~matched if policy in ("none", "hard") else ~matched | F.col("__gone")
        kept = marked.where(keep)
        if policy == "soft":
            kept = kept.withColumn(delete.marker, F.when(F.col("__gone"), True).otherwise(F.col(f"`{delete.marker}`")))
        fresh = stage.where(~gone).withColumn(_BUCKET, _bucket(keys, n))
        if policy == "soft":
            fresh = fresh.withColumn(delete.marker, F.lit(False))
        path = self._new(target)
        out = kept.select(*names, _BUCKET).unionByName(_by_bucket(fresh.select(*names, _BUCKET)))
        out.write.partitionBy(_BUCKET).option("compression", "zstd").parquet(f"{self.root}/{path}")
        written = {name for name, *_ in self.folder.list(path)}
        for b in touched:
            part = f"{_BUCKET}={b}"
            pointer["paths"][str(b)] = [f"{path}/{part}"] if part in written else []
        updated, deleted = seen.get["updated"] or 0, seen.get["deleted"] or 0
        if delete is None:
            return pointer | {"rows": pointer["rows"] + total - updated}, {"kind": "keyed", "rows_written": total, "inserted": total - updated, "updated": updated}
        deletes = stage.where(gone).count()
        pointer["rows"] += total - deletes - updated - deleted * (policy == "hard")
        counts = {"inserted": total - deletes - updated, "updated": updated, "hard_deleted": 0, "soft_deleted": 0, "ignored_delete": 0, "missing_delete": deletes - deleted}
        counts[{"hard": "hard_deleted", "soft": "soft_deleted", "ignore": "ignored_delete"}[policy]] = deleted
        return pointer, {"kind": "keyed", **counts}

    def _rebucketed(self, target: str, pointer: dict, keys: Sequence[str], buckets: int) -> dict:
        """Lay an existing target out by another key or in more buckets, once."""
        rows = self._rows(pointer, list(pointer["paths"].values()))
        path = self._new(target)
        _by_bucket(rows.withColumn(_BUCKET, _bucket(keys, buckets))).write.partitionBy(_BUCKET).option("compression", "zstd").parquet(f"{self.root}/{path}")
        written = [name for name, *_ in self.folder.list(path) if name.startswith(_BUCKET)]
        return pointer | {"keys": list(keys), "buckets": buckets, "paths": {w.partition("=")[2]: [f"{path}/{w}"] for w in written}}

    def deliver_routed(
        self, target: str, package: DataFrame, token: str, disposition: str, max_targets: int, keys: Sequence[str] = (), delete: Delete = Delete(), op: str = "op", buckets: int | None = None
    ) -> list[Receipt]:
        """Load a package with a route column, one output a route; keys repeat only within a route.

        The package is written once, a folder a route, and all outputs appear with one pointer.
        """
        if disposition not in DESTINATIONS["parquet"].dispositions:
            raise DeliveryError(f"parquet does not take {disposition}")
        staged = cut(package)
        found = staged.groupBy(ROUTE).count().limit(max_targets + 1).collect()
        if len(found) > max_targets:
            raise DeliveryError(f"{target} has more than {max_targets} routes")
        if (done := self._routed_before(target, token)) is not None:
            return done
        counts = {r[ROUTE]: r["count"] for r in found}
        routes = sorted(counts)
        numbered = staged.withColumn(_BUCKET, F.array_position(F.array(*map(F.lit, routes)), F.col(ROUTE)) if routes else F.lit(0)).drop(ROUTE)
        base = self._new(target)
        _by_bucket(numbered).write.partitionBy(_BUCKET).option("compression", "zstd").parquet(f"{self.root}/{base}")
        schema = staged.drop(ROUTE).schema
        for _ in range(ATTEMPTS):
            version = self._version(target)
            before = self._load(target, version) or {"outputs": {}}
            outputs, receipts = dict(before["outputs"]), []
            for at, route in enumerate(routes, 1):
                output = route.replace(":", "=")
                rows = self.spark.read.schema(schema).parquet(f"{self.root}/{base}/{_BUCKET}={at}")
                old = outputs.get(output)
                if disposition in ("merge", "cdc_apply"):
                    pointer, counted = self._keyed(f"{target}/{output}", old, rows, keys, delete if disposition == "cdc_apply" else None, op, buckets)
                else:
                    pointer, counted = self._added(f"{target}/{output}", old if disposition == "append" else None, rows, f"{base}/{_BUCKET}={at}", counts[route])
                receipt = self._receipt(f"{target}/{output}", disposition, token, rows, counted)
                outputs[output] = pointer
                receipts.append(receipt)
            if self._publish(target, {"outputs": outputs, "token": token, "receipts": [asdict(r) for r in receipts]}, version + 1):
                return [self._acknowledge(r) for r in receipts]
        raise DeliveryError(f"other writers were first to {target} {ATTEMPTS} times")

    def _routed_before(self, target: str, token: str) -> list[Receipt] | None:
        """The receipts of a routed load that was published, whether or not all were written."""
        for version in range(self._version(target), 0, -1):
            found = self._load(target, version)
            if found.get("token") == token:
                return [self.receipt(r["target"], token) or self._acknowledge(Receipt(**r)) for r in found["receipts"]]
        return None

    def mirror_quarantine(self, target: str, evidence: DataFrame, token: str) -> int:
        """Write quarantine records beside the target; a package's records are written once."""
        name = f"quarantine/{target}/{token}"
        if self.folder.exists(f"{name}/_SUCCESS"):
            return self.spark.read.parquet(f"{self.root}/{name}").count()
        self.folder.delete(name)
        return self._write(evidence, name)


def commit_counts(target: DataFrame, stage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(inserted, updated) that a merge would give: one left join on the key, and one aggregate."""
    known = target.select(*keys).distinct().withColumn("__t", F.lit(1))
    joined = stage.join(known, list(keys), "left")
    return joined.agg(
        F.coalesce(F.sum(F.col("__t").isNull().cast("long")), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum(F.col("__t").isNotNull().cast("long")), F.lit(0)).alias("updated"),
    )
