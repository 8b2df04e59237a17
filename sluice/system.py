"""What past runs left behind as tables for read-only SQL, with freshness and drift on top."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.errors import AdmissionError
from sluice.functions.sqltext import tokens
from sluice.ledger import Ledger
from sluice.plans.resource import Resource
from sluice.sinks.lake import Lake
from sluice.sinks.package import Packages

# fixed values: the system tables and their columns
TABLES = {
    "compilation_resources": "resource_id string, source string, target string, disposition string, trust string, compilation_json string",
    "manifest_project": "project string, resource_count bigint",
    "manifest_inputs": "resource_id string, source string, arguments_json string",
    "manifest_resources": "resource_id string, target string, disposition string, cursor string, execution string",
    "manifest_fields": "resource_id string, ordinal int, path string, field_json string, semantic_reference string, semantic_definition_hash string",
    "manifest_semantics": "resource_id string, field string, semantic_reference string",
    "manifest_lineage": "edge_id string, from_json string, to_json string, relation string",
    "manifest_diagnostics": "resource_id string, severity string, message string",
    "checkpoints": "sequence bigint, checkpoint_id string, pipeline_id string, resource_id string, scope_json string, state_version int, parent_checkpoint_id string, input_position_json string, "
    "output_position_json string, package_hash string, schema_hash string, receipt_id string, status string, is_head boolean, created_at_ms bigint, committed_at_ms bigint, delta_json string, receipt_json string, rewind_target_checkpoint_id string",
    "packages": "package_path string, package_id string, package_hash string, status string, signing_input string, signature string, identity_file_count bigint, segment_count bigint, receipt_count bigint",
    "package_files": "package_hash string, package_id string, path string, byte_count bigint, sha256 string",
    "package_segments": "package_hash string, package_id string, segment_id string, path string, row_count bigint, byte_count bigint, sha256 string",
    "package_receipts": "package_hash string, package_id string, receipt_id string, destination string, target string, disposition string, idempotency_token string, count_kind string, rows_written bigint, rows_inserted bigint, "
    "rows_updated bigint, rows_deleted bigint, hard_deletes bigint, soft_deletes bigint, missing_delete_keys bigint, ignored_deletes bigint, schema_hash string, committed_at_ms bigint, receipt_json string",
    "package_receipt_segments": "package_hash string, package_id string, receipt_id string, segment_id string, row_count bigint, byte_count bigint",
}
_WRITES = frozenset(
    "INSERT UPDATE DELETE MERGE CREATE ALTER DROP TRUNCATE REPLACE ATTACH DETACH PRAGMA VACUUM REINDEX GRANT REVOKE SET USE CACHE UNCACHE REFRESH LOAD MSCK ANALYZE COPY CALL EXPORT IMPORT INSTALL BEGIN COMMIT ROLLBACK".split()
)


def mount(spark: SparkSession, lake: Lake, packages: Packages, ledger: Ledger, resources: list[Resource] = ()) -> dict[str, DataFrame]:
    """Register the system tables as temporary views; they hold metadata, a row for each run or file."""
    rows: dict[str, list[dict]] = {t: [] for t in TABLES}
    for r in resources:
        rows["compilation_resources"].append({"resource_id": r.resource_id, "source": r.source, "target": r.target, "disposition": r.disposition, "trust": r.trust, "compilation_json": json.dumps(asdict(r), default=str)})
        rows["manifest_inputs"].append({"resource_id": r.resource_id, "source": r.source, "arguments_json": json.dumps(r.arguments)})
        rows["manifest_resources"].append({"resource_id": r.resource_id, "target": r.target, "disposition": r.disposition, "cursor": r.cursor, "execution": r.execution.kind})
        for i, (name, tree) in enumerate(r.outputs or ()):
            rows["manifest_fields"].append({"resource_id": r.resource_id, "ordinal": i, "path": name, "field_json": json.dumps(tree), "semantic_reference": r.semantics.get(name)})
        rows["manifest_semantics"] += [{"resource_id": r.resource_id, "field": f, "semantic_reference": s} for f, s in r.semantics.items()]
    rows["manifest_project"].append({"project": ledger.pipeline_id, "resource_count": len(resources)})
    entries = ledger.all()
    heads = {h.checkpoint_id for rid, scope in {(c.resource_id, c.scope_json) for c in entries} if (h := ledger.head(rid, scope))}
    for c in entries:
        rows["checkpoints"].append(asdict(c) | {"state_version": 1, "is_head": c.checkpoint_id in heads, "committed_at_ms": c.created_at_ms if c.status == "committed" else None})
    receipts = lake.receipts()
    by_token: dict[str, list] = {}
    for r in receipts:
        by_token.setdefault(r.token, []).append(r)
    for m in packages.all():
        own = by_token.get(m["package_hash"], [])
        key = {"package_hash": m["package_hash"], "package_id": m["package_id"]}
        rows["packages"].append(key | {"package_path": f"{packages.root}/{m['package_id']}", "status": m["status"], "identity_file_count": len(m["segments"]), "segment_count": m.get("segment_count", len(m["segments"])), "receipt_count": len(own)})
        for i, s in enumerate(m["segments"]):
            rows["package_files"].append(key | s)
            rows["package_segments"].append(key | {"segment_id": f"{i:06d}", **s})
        for i, edge in enumerate(m["lineage"]):
            rows["manifest_lineage"].append({"edge_id": f"{m['package_id']}-{i}", "from_json": json.dumps(edge["from"]), "to_json": json.dumps(edge["to"]), "relation": edge["relation"]})
        for r in own:
            c = r.counts
            rows["package_receipts"].append(
                key
                | {"receipt_id": r.receipt_id, "destination": r.destination, "target": r.target, "disposition": r.disposition, "idempotency_token": r.token, "count_kind": c.get("kind"), "schema_hash": r.schema_hash, "committed_at_ms": r.committed_at_ms}
                | {"rows_written": c.get("rows_written"), "rows_inserted": c.get("inserted"), "rows_updated": c.get("updated"), "rows_deleted": c.get("hard_deleted")}
                | {"hard_deletes": c.get("hard_deleted"), "soft_deletes": c.get("soft_deleted"), "missing_delete_keys": c.get("missing_delete"), "ignored_deletes": c.get("ignored_delete"), "receipt_json": json.dumps(asdict(r))}
            )
            rows["package_receipt_segments"] += [key | {"receipt_id": r.receipt_id, "segment_id": f"{i:06d}", "byte_count": s["byte_count"]} for i, s in enumerate(m["segments"])]
    out = {}
    for name, ddl in TABLES.items():
        names = [part.split()[0] for part in ddl.split(", ")]
        out[name] = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows[name]], ddl)
        out[name].createOrReplaceTempView(name)
    return out


def check_read_only(sql: str) -> None:
    """One SELECT or WITH; words that change anything are refused wherever they stand in code."""
    found = tokens(sql)
    while found and found[-1].text == ";":
        found.pop()
    if not found or found[0].upper not in ("SELECT", "WITH"):
        raise AdmissionError("system SQL is one SELECT or WITH")
    if any(t.text == ";" for t in found):
        raise AdmissionError("system SQL is one statement")
    if bad := next((t for t in found if t.upper in _WRITES), None):
        raise AdmissionError(f"{bad.upper} is refused in system SQL")


def system_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Any read-only SQL over the mounted tables: joins, aggregates, windows and set operations are Spark's."""
    check_read_only(sql)
    return spark.sql(sql.strip().rstrip(";"))


def freshness(observed: DataFrame, now_ms: int) -> DataFrame:
    """Status of (resource_id, last_ms, max_age_ms): fresh, stale, or non_evaluable without a time or an objective."""
    age = F.lit(now_ms) - F.col("last_ms")
    status = F.when(F.col("last_ms").isNull() | F.col("max_age_ms").isNull(), "non_evaluable").when(age > F.col("max_age_ms"), "stale").otherwise("fresh")
    return observed.select("resource_id", age.alias("age_ms"), status.alias("status"))


def freshness_summary(status: DataFrame) -> DataFrame:
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return status.agg(F.count(F.lit(1)).alias("total"), count("fresh"), count("stale"), count("non_evaluable"))


def drift(ledger_rows: DataFrame, destination_rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with their state: match, differs, missing_in_destination or unknown_to_ledger.  One full outer join."""
    a = ledger_rows.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__l"))
    b = destination_rows.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__d"))
    both = a.join(b, keys, "full_outer")
    state = F.when(F.col("__d").isNull(), "missing_in_destination").when(F.col("__l").isNull(), "unknown_to_ledger").when(F.col("__a").eqNullSafe(F.col("__b")), "match").otherwise("differs")
    return both.select(*keys, state.alias("state"))


def clean_streaks(runs: DataFrame) -> DataFrame:
    """(resource_id, clean_runs): runs without quarantine since each resource's last run with any."""
    from pyspark.sql import Window as W

    w = W.partitionBy("resource_id").orderBy(F.desc("sequence")).rowsBetween(W.unboundedPreceding, 0)
    marked = runs.withColumn("__dirty", F.max((F.col("quarantined_rows") > 0).cast("int")).over(w))
    return marked.groupBy("resource_id").agg(F.count(F.when(F.col("__dirty") == 0, 1)).alias("clean_runs"))
