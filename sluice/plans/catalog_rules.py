"""Queries of rules, schemas, statistics, positions and state."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import positions as P
from sluice.operators import contract as C
from sluice.operators import late, residual, schema, statistics
from sluice.operators.dedup import keep_one
from sluice.plans.lints import filter_lints
from sluice.plans.registration import decisions, outcome, query, scratch, table, values
from sluice.plans.resource import DESTINATIONS, Execution
from sluice.storage import Folder
from sluice.streaming.changes import committed_transactions, event_prefix
from sluice.streaming.epochs import Controller, Magnitudes

# -- contracts


@query("SELECT event_id, false AS violated FROM events UNION ALL SELECT -1, true")
def range_and_nan(spark, sf_dir):
    """NaN passes a range without bounds; against a bound it is an error, here told by the row -1."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    passed = C.with_violations(events, C.Contract((C.Range("open", "value"),))).select("event_id", (F.size("violations") > 0).alias("violated"))
    bounded = C.Range("bounded", "value", "0").violated(T.DoubleType())
    # the error stands in the expression and is raised for NaN alone
    raises = "raise_error" in bounded._jc.toString()
    return passed.unionByName(spark.createDataFrame([(-1, raises)], "event_id bigint, violated boolean"))


@query("SELECT user_id % 7 AS a, event_type AS b, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_map_keys(spark, sf_dir):
    """Map keys count as equal whatever the order of their entries."""
    u, e = F.col("user_id") % 7, F.col("event_type")
    one, other = F.create_map(F.lit("a"), u.cast("string"), F.lit("b"), e), F.create_map(F.lit("b"), e, F.lit("a"), u.cast("string"))
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, one).otherwise(other).alias("m"))
    kept = keep_one(events, ["m"], ["event_id"])
    return kept.select(F.element_at("m", "a").cast("bigint").alias("a"), F.element_at("m", "b").alias("b"), "event_id")


_FAILS = [("o_orderkey", "ok"), ("o_custkey", "ContractError"), ("o_orderkey,o_custkey", "ok"), ("o_orderstatus", "ContractError")]


@query(values(_FAILS, "keys, outcome"))
def dedup_fail(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return decisions(spark, [(k, outcome(lambda k=k: keep_one(orders, k.split(","), ["o_orderkey"], "fail"))) for k, _ in _FAILS], "keys string, outcome string")


@query(
    """SELECT t.trust, o.outcome, CASE WHEN o.outcome IN ('pass', 'coerced', 'admitted_as_variant') THEN 'accept' WHEN o.outcome = 'fatal' OR t.trust IN ('experimental', 'financial') THEN 'reject_run' ELSE 'quarantine' END AS verdict
    FROM (VALUES ('experimental'), ('governed'), ('financial'), ('serving')) t(trust), (VALUES ('pass'), ('coerced'), ('admitted_as_variant'), ('violation'), ('fatal')) o(outcome)"""
)
def verdict_lattice(spark, sf_dir):
    rows = [(name, o.value, v.value) for name, preset in C.TRUST.items() for o, v in preset.verdicts().items()]
    return decisions(spark, rows, "trust string, outcome string, verdict string")


@query(
    """SELECT trust, trust = 'serving' AS samples, trust = 'serving' AS freshness, trust = 'financial' AS receipts, trust = 'financial' AS lineage, CASE WHEN trust = 'financial' THEN 'fail_run' ELSE 'capture_variant' END AS field
    FROM (VALUES ('experimental'), ('governed'), ('financial'), ('serving')) t(trust)"""
)
def trust_presets(spark, sf_dir):
    rows = [(n, p.depth == "sampled_fast_path", p.freshness_slo, p.require_receipts, p.full_lineage, p.field) for n, p in C.TRUST.items()]
    return decisions(spark, rows, "trust string, samples boolean, freshness boolean, receipts boolean, lineage boolean, field string")


@query(
    """SELECT t.trust, n.runs::INT AS runs, d.drift, a.anomaly, q.quarantined::INT AS quarantined, CASE WHEN t.trust = 'serving' AND n.runs >= 3 AND NOT d.drift AND NOT a.anomaly AND q.quarantined = 0 THEN 'sampled_fast_path' ELSE 'full' END AS depth
    FROM (VALUES ('experimental'), ('governed'), ('financial'), ('serving')) t(trust), (VALUES (0), (2), (3), (9)) n(runs), (VALUES (true), (false)) d(drift), (VALUES (true), (false)) a(anomaly), (VALUES (0), (4)) q(quarantined)"""
)
def validation_depth(spark, sf_dir):
    rows = [(t, n, d, a, q, C.validation_depth(p, n, drift=d, anomaly=a, quarantined=q)) for t, p in C.TRUST.items() for n in (0, 2, 3, 9) for d in (True, False) for a in (True, False) for q in (0, 4)]
    return decisions(spark, rows, "trust string, runs int, drift boolean, anomaly boolean, quarantined int, depth string")


_LINTS = [
    ("no bound", "r: always true"), ("crossed", "r: unsatisfiable"), ("sound", ""), ("k > 5 AND k < 3", "no value of k passes"), ("k >= 5 AND k <= 5", ""), ("k = null", "k = null is never true"),
    ("k > 7 after 9", "k > 7 is subsumed by the committed cursor"), ("k > 12 after 9", ""),
]


@query(values(_LINTS, "subject, finding"))
def rule_lints(spark, sf_dir):
    found = {
        "no bound": C.Range("r", "v").lints(), "crossed": C.Range("r", "v", "5", "3").lints(), "sound": C.Range("r", "v", "3", "5").lints(),
        "k > 5 AND k < 3": filter_lints(["k > 5 AND k < 3"]), "k >= 5 AND k <= 5": filter_lints(["k >= 5 AND k <= 5"]), "k = null": filter_lints(["k = null"]),
        "k > 7 after 9": filter_lints(["k > 7"], "k", 9), "k > 12 after 9": filter_lints(["k > 12"], "k", 9),
    }
    return decisions(spark, [(k, "; ".join(v)) for k, v in found.items()], "subject string, finding string")


# -- schemas

_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal(12,2)", "string", "boolean", "date", "timestamp", "binary")
_POLICIES = {"default": schema.TypePolicy(), "no coercion": schema.TypePolicy(coerce_types=False), "lossy": schema.TypePolicy(allow_lossy_mapping=True)}


def _kind(name: str) -> T.DataType:
    return T._parse_datatype_string(f"x {name}")[0].dataType


_KINDS_SQL = """(VALUES ('tinyint', 'int', 8, 3), ('smallint', 'int', 16, 5), ('int', 'int', 32, 10), ('bigint', 'int', 64, 19), ('float', 'float', 0, 0), ('double', 'float', 0, 0), ('decimal(12,2)', 'decimal', 0, 0),
    ('string', 'text', 0, 0), ('boolean', 'bool', 0, 0), ('date', 'time', 0, 0), ('timestamp', 'time', 0, 0), ('binary', 'bytes', 0, 0))"""
_WIDENS_SQL = """(o.kind = 'int' AND c.kind = 'int' AND o.bits < c.bits) OR (o.kind = 'int' AND c.kind = 'decimal' AND o.digits + 2 <= 12) OR (o.name = 'float' AND c.name = 'double') OR (o.name = 'date' AND c.name = 'timestamp')"""


@query(
    f"""SELECT p.policy, o.name AS observed, c.name AS declared, CASE WHEN o.name = c.name THEN 'preserved' WHEN {_WIDENS_SQL} THEN 'widened'
    WHEN o.kind = 'text' AND c.kind IN ('int', 'float', 'decimal', 'bool', 'time') THEN CASE WHEN p.policy = 'no coercion' THEN 'lossy_rejected' ELSE 'coerced' END
    WHEN (o.kind IN ('int', 'float', 'decimal') AND c.kind IN ('int', 'float', 'decimal')) OR (o.name = 'timestamp' AND c.name = 'date') THEN CASE WHEN p.policy = 'lossy' THEN 'lossy_allowed' ELSE 'lossy_rejected' END
    ELSE 'unsupported' END AS decision FROM {_KINDS_SQL} o(name, kind, bits, digits), {_KINDS_SQL} c(name, kind, bits, digits), (VALUES ('default'), ('no coercion'), ('lossy')) p(policy)"""
)
def reconcile_types(spark, sf_dir):
    rows = [(n, o, c, schema.reconcile_type(_kind(o), _kind(c), p)[0]) for n, p in _POLICIES.items() for o in _TYPES for c in _TYPES]
    return decisions(spark, rows, "policy string, observed string, declared string, decision string")


@query(f"SELECT o.name AS observed, c.name AS declared, o.name <> c.name AND ({_WIDENS_SQL}) AS widens FROM {_KINDS_SQL} o(name, kind, bits, digits), {_KINDS_SQL} c(name, kind, bits, digits)")
def lossless_widening(spark, sf_dir):
    return decisions(spark, [(o, c, schema.widens(_kind(o), _kind(c))) for o in _TYPES for c in _TYPES], "observed string, declared string, widens boolean")


@query("SELECT name AS type, length(power(2::DOUBLE, bits - 1)::HUGEINT::VARCHAR)::INT AS digits FROM (VALUES ('tinyint', 8), ('smallint', 16), ('int', 32), ('bigint', 64)) t(name, bits)")
def digit_table(spark, sf_dir):
    return decisions(spark, list(schema.DIGITS.items()), "type string, digits int")


@query("SELECT event_id, TRY_CAST(t AS BIGINT) AS n, t IS NOT NULL AND TRY_CAST(t AS BIGINT) IS NULL AS unfit, b = 'true' AS flag FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id WHEN event_id % 7 <> 0 THEN event_id::VARCHAR END AS t, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS b FROM events)")
def parse_coercion(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "event_id")).when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string"))
    events = table(spark, sf_dir, "events").select("event_id", text.alias("n"), F.when(F.col("user_id") % 2 == 0, "true").otherwise("false").alias("flag"))
    marked = events.withColumn("unfit", schema.unfit(F.col("n"), T.LongType()))
    return schema.conform(marked, T.StructType.fromDDL("event_id bigint, n bigint, flag boolean, unfit boolean"))[0]


@query(values([("coerce_types", True), ("preserve_decimal_exactness", True), ("preserve_timestamp_timezone", True), ("allow_lossy_mapping", False)], "policy, setting"))
def default_type_policy(spark, sf_dir):
    return decisions(spark, [(f.name, getattr(schema.TypePolicy(), f.name)) for f in fields(schema.TypePolicy)], "policy string, setting boolean")


@query("SELECT count(*)::BIGINT AS rows, count(DISTINCT event_type)::BIGINT AS texts, 'ContractError' AS conflict FROM events")
def variant_assembly(spark, sf_dir):
    """One residual text a row; a column that is called so already is an error."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    captured = residual.capture(events, ["event_id"])
    conflict = outcome(lambda: residual.capture(captured.withColumn("x", F.lit(1)), ["event_id"]))
    return captured.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(residual.VARIANT_COLUMN).alias("texts")).withColumn("conflict", F.lit(conflict))


@query("SELECT o_orderkey % 9 AS k, '/o_orderstatus' AS path, 'string' AS type, count(*)::BIGINT AS rows FROM orders WHERE false GROUP BY 1 UNION ALL SELECT NULL, '/' || p, t, (SELECT count(*) FROM orders)::BIGINT FROM (VALUES ('o_orderstatus', 'string'), ('o_totalprice', 'double')) v(p, t)")
def promotion_candidates(spark, sf_dir):
    captured = residual.capture(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"])
    return residual.promotion_candidates(captured).select(F.lit(None).cast("bigint").alias("k"), "path", "type", "rows")


_SAME = [("itself", True), ("metadata in another order", True), ("another name", False), ("another type", False), ("not nullable", False), ("columns in another order", False)]


@query(values(_SAME, "schema, equal"))
def schema_fingerprints(spark, sf_dir):
    base = table(spark, sf_dir, "nation").schema
    first, rest = base[0], base.fields[1:]
    tagged = lambda meta: T.StructType([T.StructField(first.name, first.dataType, True, meta), *rest])
    pairs = {
        "itself": (base, T.StructType.fromJson(base.jsonValue())),
        "metadata in another order": (tagged({"a": 1, "b": 2}), tagged({"b": 2, "a": 1})),
        "another name": (base, T.StructType([T.StructField("other", first.dataType), *rest])),
        "another type": (base, T.StructType([T.StructField(first.name, T.BinaryType()), *rest])),
        "not nullable": (base, T.StructType([T.StructField(first.name, first.dataType, not first.nullable), *rest])),
        "columns in another order": (base, T.StructType([*rest, first])),
    }
    return decisions(spark, [(k, schema.fingerprint(a) == schema.fingerprint(b)) for k, (a, b) in pairs.items()], "schema string, equal boolean")


_TAKEN = ("bigint", "string", "double", "decimal(10,2)", "date", "timestamp", "map<string,int>", "struct<a:int>", "array<int>", "void")


@query(
    """SELECT d.destination, t.type, a.lossy, CASE WHEN (d.destination = 'sqlite' AND t.kind IN ('map', 'struct', 'array')) OR (d.destination = 'clickhouse' AND t.kind IN ('map', 'struct')) THEN 'SchemaError'
    WHEN a.lossy THEN 'ok' WHEN (d.destination = 'postgres' AND t.kind IN ('map', 'struct', 'array')) OR (d.destination = 'sqlite' AND t.kind IN ('decimal', 'timestamp', 'date')) OR (d.destination = 'parquet' AND t.kind = 'void') THEN 'SchemaError' ELSE 'ok' END AS outcome
    FROM (VALUES ('duckdb'), ('postgres'), ('sqlite'), ('clickhouse'), ('parquet')) d(destination), (VALUES (true), (false)) a(lossy),
    (VALUES ('bigint', 'long'), ('string', 'string'), ('double', 'double'), ('decimal(10,2)', 'decimal'), ('date', 'date'), ('timestamp', 'timestamp'), ('map<string,int>', 'map'), ('struct<a:int>', 'struct'), ('array<int>', 'array'), ('void', 'void')) t(type, kind)"""
)
def destination_types(spark, sf_dir):
    one = lambda t: T.StructType([T.StructField("x", _kind(t) if t != "void" else T.NullType())])
    rows = [(d, t, lossy, outcome(lambda d=d, t=t, lossy=lossy: schema.check_destination(one(t), DESTINATIONS[d], lossy))) for d in ("duckdb", "postgres", "sqlite", "clickhouse", "parquet") for t in _TAKEN for lossy in (True, False)]
    return decisions(spark, rows, "destination string, type string, lossy boolean, outcome string")


_JOINED = [
    ("a", "k", "preserved"), ("a", "v", "widened"), ("a", "w", "missing_null"), ("b", "k", "widened"), ("b", "v", "preserved"), ("b", "w", "preserved"), ("c", "k", "preserved"), ("c", "v", "missing_null"), ("c", "w", "incompatible"),
]


@query(values(_JOINED, 'location, "field", verdict'))
def schema_join_verdicts(spark, sf_dir):
    located = {"b": T.StructType.fromDDL("k int, v double, w string"), "a": T.StructType.fromDDL("k bigint, v float"), "c": T.StructType.fromDDL("k bigint, w array<int>")}
    return decisions(spark, [(v["location"], v["field"], v["verdict"]) for v in schema.join_schemas(located)[1]], "location string, field string, verdict string")


# -- statistics


@query(
    """SELECT c AS "column", count(*)::BIGINT AS row_count, count(*) FILTER (v IS NULL)::BIGINT AS null_count, CASE c WHEN 'o_totalprice' THEN min(v::DOUBLE)::VARCHAR ELSE min(v::BIGINT)::VARCHAR END AS minimum,
    CASE c WHEN 'o_totalprice' THEN max(v::DOUBLE)::VARCHAR ELSE max(v::BIGINT)::VARCHAR END AS maximum, true AS complete FROM (SELECT 'o_orderkey' AS c, o_orderkey::VARCHAR AS v FROM orders
    UNION ALL SELECT 'o_custkey', nullif(o_custkey, 7)::VARCHAR FROM orders UNION ALL SELECT 'o_totalprice', o_totalprice::VARCHAR FROM orders) GROUP BY c"""
)
def merged_statistics(spark, sf_dir):
    """Profiles of parts of a table, stored apart and joined to the profile of the whole."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("o_custkey"), "o_totalprice", F.pmod("o_orderkey", F.lit(6)).alias("part"))
    parts = statistics.profile(orders, ["part"])
    return statistics.merge_profiles(parts, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"})


_PRUNED = {
    "k = 450": "lo <= 450 AND hi >= 450", "k != 450": "NOT (lo = 450 AND hi = 450)", "k < 450": "lo < 450", "k <= 450": "lo <= 450", "k > 450": "hi > 450", "k >= 450": "hi >= 450", "NOT k > 450": "lo <= 450",
    "k > 450 AND k < 650": "hi > 450 AND lo < 650", "k < 150 OR k > 850": "lo < 150 OR hi > 850", "f = true": "fhi", "f = false": "NOT flo", "t = 'click'": "tlo <= 'click' AND thi >= 'click'", "t > 'purchase'": "thi > 'purchase'",
    "v < 10.5": "vlo < 10.5", "n IS NULL": "nulls > 0", "n IS NOT NULL": "nulls < rows",
}


@query(
    "WITH s AS (SELECT event_id // 100 AS segment, min(event_id) AS lo, max(event_id) AS hi, bool_and(event_id >= 500) AS flo, bool_or(event_id >= 500) AS fhi, min(event_type) AS tlo, max(event_type) AS thi, min(value) AS vlo, "
    "count(*) FILTER (event_id >= 300) AS nulls, count(*) AS rows FROM events GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT segment, '{p.replace(chr(39), chr(39) * 2)}' AS predicate, CASE WHEN {test} THEN 'retained_may_match' ELSE 'pruned' END AS outcome FROM s" for p, test in _PRUNED.items())
)
def prune_operators(spark, sf_dir):
    """Every operator and type that segments are pruned by."""
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.expr("event_id div 100").alias("segment"), F.col("event_id").alias("k"), (F.col("event_id") >= 500).alias("f"), F.col("event_type").alias("t"), F.col("value").alias("v"), F.when(F.col("event_id") < 300, F.col("user_id")).alias("n")
    )
    profiles = statistics.profile(rows, ["segment"])
    kinds = {"k": "bigint", "f": "boolean", "t": "string", "v": "double", "n": "bigint"}
    parts = [statistics.prune(profiles, "segment", p, kinds).select("segment", F.lit(p).alias("predicate"), "outcome") for p in _PRUNED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -- positions and ledgers

_POSITIONS = {
    "int 5": P.Cursor("k", "int", "5"), "int 9": P.Cursor("k", "int", "9"), "other 9": P.Cursor("j", "int", "9"), "text a": P.Cursor("k", "string", "a"), "text b": P.Cursor("k", "string", "b"), "decimal 1.5": P.Cursor("k", "decimal", "1.5"),
    "decimal 12.0": P.Cursor("k", "decimal", "12.0"), "log 3": P.Log("l", 3), "log 8": P.Log("l", 8), "files a": P.Files((("a", "1"),)), "files ab": P.Files((("a", "1"), ("b", "2"))), "files a2": P.Files((("a", "2"),)), "page x": P.Page("x"), "page y": P.Page("y"),
}


def _position_name(p) -> str:
    return next((k for k, v in _POSITIONS.items() if v == p), str(p))


_ORDER = {"int 5": ("int", 1), "int 9": ("int", 2), "text a": ("text", 1), "text b": ("text", 2), "decimal 1.5": ("decimal", 1), "decimal 12.0": ("decimal", 2), "log 3": ("log", 1), "log 8": ("log", 2), "files a": ("files", 1), "files ab": ("files", 2)}
_CHAINS = "(VALUES " + ", ".join(f"('{k}', '{c}', {n})" for k, (c, n) in {**_ORDER, "other 9": ("other", 1), "files a2": ("files2", 1), "page x": ("x", 1), "page y": ("y", 1)}.items()) + ")"


@query(
    f"""SELECT a.name AS a, b.name AS b, CASE WHEN a.chain = b.chain THEN CASE WHEN a.pos >= b.pos THEN a.name ELSE b.name END ELSE 'PositionError' END AS joined
    FROM {_CHAINS} a(name, chain, pos), {_CHAINS} b(name, chain, pos)"""
)
def position_joins(spark, sf_dir):
    def joined(a, b) -> str:
        failed = outcome(lambda: P.join(a, b))
        return failed if failed != "ok" else _position_name(P.join(a, b))

    return decisions(spark, [(m, n, joined(a, b)) for m, a in _POSITIONS.items() for n, b in _POSITIONS.items()], "a string, b string, joined string")


@query(f"SELECT a.name AS a, b.name AS b, a.chain = b.chain AND CASE WHEN a.chain IN ('text', 'decimal') THEN a.pos = b.pos ELSE a.pos >= b.pos END AS reaches FROM {_CHAINS} a(name, chain, pos), {_CHAINS} b(name, chain, pos)")
def position_reaches(spark, sf_dir):
    """Texts and decimals reach only their equals."""
    return decisions(spark, [(m, n, P.reaches(a, b)) for m, a in _POSITIONS.items() for n, b in _POSITIONS.items()], "a string, b string, reaches boolean")


@query("SELECT 'o_orderkey' AS \"field\", max(o_orderkey)::VARCHAR AS value, count(DISTINCT o_orderstatus)::BIGINT AS batches FROM orders")
def position_of_batches(spark, sf_dir):
    """The greatest cursor of many batches: one row a batch comes to the driver."""
    batches = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.max("o_orderkey").alias("m")).collect()
    p = P.aggregate([P.Cursor("o_orderkey", "int", str(r["m"])) for r in batches])
    return decisions(spark, [(p.field, p.value, len(batches))], "field string, value string, batches bigint")


@query(values([("a", "1:1"), ("b", "2:4"), ("c", "3:1"), ("d", "9:9")], "path, identity"))
def manifest_union(spark, sf_dir):
    joined = P.join(P.Files((("a", "1:1"), ("b", "2:4"), ("c", "3:1"))), P.Files((("a", "1:1"), ("d", "9:9"))))
    return decisions(spark, joined.files, "path string, identity string")


_HISTORY = [(1, "committed", "1"), (2, "committed", "2"), (3, "committed", "3"), (4, "rewound", "2"), (5, "abandoned", "2"), (6, "committed", "6")]


@query(values(_HISTORY, "sequence, status, in_force").replace("SELECT *", "SELECT sequence::BIGINT AS sequence, status, in_force"))
def ledger_history(spark, sf_dir):
    """Commits, a rewind and an abandoned run: which checkpoint is in force after each entry."""
    from sluice.ledger import Ledger
    from sluice.sinks.lake import Receipt

    ledger = Ledger(Folder(spark, scratch(spark)))
    by_id, rows = {}, []

    def note(entry) -> None:
        by_id[entry.checkpoint_id] = entry.sequence
        rows.append((entry.sequence, entry.status, str(by_id[ledger.head("r").checkpoint_id])))

    receipt = lambda n: Receipt(f"r{n}", "t", "append", f"p{n}", "s")
    second = None
    for n in (1, 2, 3):
        entry = ledger.commit("r", receipt(n))
        second = entry if n == 2 else second
        note(entry)
    note(ledger.rewind("r", second.checkpoint_id))
    note(ledger.abandon("r"))
    note(ledger.commit("r", receipt(6)))
    return decisions(spark, rows, "sequence bigint, status string, in_force string")


# -- streams

_EXECUTIONS = {
    "rows": (Execution("drain", ("rows", 10), ("rows", 25), ("records", 60)), Magnitudes(1, 10, None, 1), 6),
    "batches": (Execution("drain", None, ("batches", 2), ("quiescent", 0)), Magnitudes(1, 1, 1, 1), 4),
    "unmeasured": (Execution("drain", ("bytes", 1), ("bytes", 1), ("bytes", 1)), Magnitudes(1, 1, None, 1), 3),
    "bytes": (Execution("drain", None, ("rows", 100), ("bytes", 300)), Magnitudes(1, 1, 100, 1), 3),
    "elapsed": (Execution("drain", ("elapsed_ms", 20), ("elapsed_ms", 50), ("duration_ms", 100)), Magnitudes(1, 1, 1, 10), 10),
    "watermark": (Execution("drain", None, ("watermark_advance", 5), ("quiescent", 0)), Magnitudes(1, 1, 1, 1, 5), 2),
}
_DECIDED = {
    "rows": "checkpoint checkpoint rotate checkpoint checkpoint terminate", "batches": "continue rotate continue rotate", "unmeasured": "continue continue continue", "bytes": "continue continue terminate",
    "elapsed": "continue checkpoint continue checkpoint rotate continue checkpoint continue checkpoint terminate", "watermark": "rotate rotate",
}


@query(values([(k, i, d) for k, v in _DECIDED.items() for i, d in enumerate(v.split())], "execution, step, decision"))
def epoch_decisions(spark, sf_dir):
    """What follows each frontier: termination before rotation before checkpoint, and nothing of what cannot be measured."""
    rows = []
    for name, (execution, step, n) in _EXECUTIONS.items():
        controller = Controller(execution)
        rows += [(name, i, controller.offer(step)) for i in range(n)]
    return decisions(spark, rows, "execution string, step int, decision string")


@query("SELECT event_type, max(ts) AS watermark FROM events GROUP BY event_type")
def partition_claims(spark, sf_dir):
    """Claims of partitions move on with each epoch; partitions without news keep theirs."""
    events = table(spark, sf_dir, "events")
    early = late.partition_watermarks(events.where("event_id % 2 = 0"), "event_type", "ts")
    both = late.partition_watermarks(events, "event_type", "ts")
    return late.advance(early, both)


_WATERMARKS = [("all claim", 5), ("one has none", 3), ("one has none but is idle", 7), ("lower than before", 3)]


@query(values(_WATERMARKS, "claims, watermark").replace("SELECT *", "SELECT claims, watermark::BIGINT AS watermark"))
def watermark_rules(spark, sf_dir):
    """The least claim; waits for partitions without one, leaves out idle ones, and never goes back."""
    cases = {
        "all claim": ([("a", 5), ("b", 9)], ()), "one has none": ([("a", 5), ("b", None)], ()), "one has none but is idle": ([("a", 7), ("b", None)], ("b",)), "lower than before": ([("a", 2), ("b", 9)], ()),
    }
    parts = [late.global_watermark(spark.createDataFrame(rows, "part string, watermark bigint"), 3, idle).select(F.lit(k).alias("claims"), "watermark") for k, (rows, idle) in cases.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_DOMAINS = [(t, "ok") for t in ("tinyint", "smallint", "int", "bigint", "decimal(10,2)", "date", "timestamp", "timestamp_ntz")] + [(t, "ContractError") for t in ("string", "double", "float", "boolean", "binary")]


@query(values(_DOMAINS, "type, outcome"))
def event_time_domains(spark, sf_dir):
    rows = [(t, outcome(lambda t=t: late.split_late(spark.range(0).select(F.lit(None).cast(t).alias("t")), "t", None))) for t, _ in _DOMAINS]
    return decisions(spark, rows, "type string, outcome string")


_SURVIVES = [("*", "preserve"), ("ts", "preserve"), ("ts + 1 AS ts", "transform"), ("value AS ts", "transform"), ("ts AS other", "drop"), ("value", "drop")]


@query(values(_SURVIVES, "projection, behaviour"))
def watermark_behaviour(spark, sf_dir):
    outputs = {
        "*": None, "ts": (("ts", ("col", "ts")),), "ts + 1 AS ts": (("ts", ("op", "+", ("col", "ts"), ("lit", 1))),), "value AS ts": (("ts", ("col", "value")),), "ts AS other": (("other", ("col", "ts")),), "value": (("value", ("col", "value")),),
    }
    return decisions(spark, [(k, late.survives(v, "ts")) for k, v in outputs.items()], "projection string, behaviour string")


_LOG = "SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'terminal' END AS marker FROM events"


@query(f"SELECT user_id, count(*)::BIGINT AS changes, user_id IN (SELECT user_id FROM ({_LOG}) WHERE marker = 'terminal') AS settled FROM ({_LOG}) WHERE marker IS NULL GROUP BY user_id")
def committed_changes(spark, sf_dir):
    """Changes settle with their transaction's terminal marker; the others wait."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "terminal").alias("marker"))
    settled, waiting = committed_transactions(log, "user_id")
    both = settled.withColumn("settled", F.lit(True)).unionByName(waiting.withColumn("settled", F.lit(False)))
    return both.groupBy("user_id", "settled").agg(F.count(F.lit(1)).alias("changes"))


@query(f"SELECT event_id <= last AS settled, count(*)::BIGINT AS changes, any_value(last) AS upto FROM ({_LOG}), (SELECT max(event_id) AS last FROM ({_LOG}) WHERE marker = 'terminal') WHERE marker IS NULL GROUP BY 1")
def settled_prefix(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "terminal").alias("marker"))
    settled, rest, last = event_prefix(log, "event_id")
    both = settled.withColumn("settled", F.lit(True)).unionByName(rest.withColumn("settled", F.lit(False)))
    return both.groupBy("settled").agg(F.count(F.lit(1)).alias("changes")).withColumn("upto", F.lit(last).cast("bigint"))


@query("SELECT event_id, false AS late FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_id < 500)")
def recaptured_rows(spark, sf_dir):
    """Late rows are carried into the next epoch, the others admitted."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    committed = events.where("event_id < 500").agg(F.max("ts").alias("w")).first()["w"]  # the committed watermark: one value
    split = late.split_late(events, "ts", committed, "recapture_next_epoch")
    again = split.admitted.unionByName(split.carried)
    whole = again.join(events, ["event_id", "ts"], "left_anti").select("event_id", F.lit(True).alias("late"))
    return split.admitted.select("event_id", F.lit(False).alias("late")).unionByName(whole)
