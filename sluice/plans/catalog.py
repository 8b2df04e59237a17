"""All queries of the engine over the given tables, and the SQL they are held against.

Every query reads its whole tables.  Language, rules and state, sources and targets have modules of their own beside
this one.  Names that start with ``ext_`` are plain relational SQL, which the resource
language refuses and a Spark user has anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.expressions import comparison, declared, filter_rows, project, scalar
from sluice.ledger import Ledger
from sluice.operators import contract as C
from sluice.operators import late, residual, routing, schema, segments, statistics, transforms
from sluice.operators.dedup import dedup_summary, distinct_rows, keep_one, reduce_changes, split_changes
from sluice.plans.frontend import parse_resource
from sluice.plans.registration import ORACLE_SQL, QUERIES, query, scratch
from sluice.plans.registration import table as _table
from sluice.plans.resource import Delete
from sluice.plans.run import Options, Registry, parquet_source, plan, run
from sluice.sinks.lake import Lake, applied_changes, commit_counts, merged_rows
from sluice.sinks.package import Packages
from sluice.sources.files import changed_files
from sluice.sources.tables import apply_equality_deletes, apply_position_deletes
from sluice.storage import Folder
from sluice.system import clean_streaks, drift, freshness, freshness_summary

# -- the flagship: a governed resource from SQL text to accepted rows --------------------------------

FLAGSHIP = """
RESOURCE TRUST GOVERNED AS
SELECT l_orderkey, l_linenumber, l_discount, l_returnflag, l_extendedprice * (1 - l_discount) AS net
FROM upstream(source => 'tpch', table => 'lineitem')
WHERE l_quantity >= 10
"""
LINEITEM_CONTRACT = C.Contract(
    rules=(
        C.Nullability("orderkey_there", "l_orderkey"),
        C.Range("discount_range", "l_discount", "0.01", "0.09"),
        C.Domain("flag_known", "l_returnflag", ("A", "N")),
    )
)


@query(
    """SELECT l_orderkey, l_linenumber, l_discount, l_returnflag, l_extendedprice * (1 - l_discount) AS net FROM lineitem
    WHERE l_quantity >= 10 AND l_orderkey IS NOT NULL AND l_discount BETWEEN 0.01 AND 0.09 AND l_returnflag IN ('A', 'N')"""
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry({"tpch": parquet_source(sf_dir)})
    return plan(spark, parse_resource(FLAGSHIP), registry, Options(LINEITEM_CONTRACT)).accepted


# -- projection, filter, functions ---------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_quantity * 2 AS twice, l_extendedprice - l_tax AS less FROM lineitem WHERE l_quantity < 5 OR l_returnflag = 'R'")
def project_filter(spark, sf_dir):
    outputs = [("l_orderkey", "l_orderkey"), ("l_partkey", "l_partkey"), ("twice", "l_quantity * 2"), ("less", "l_extendedprice - l_tax")]
    return project(_table(spark, sf_dir, "lineitem"), outputs, "l_quantity < 5 OR l_returnflag = 'R'")


@query("SELECT o_orderkey, o_custkey IS DISTINCT FROM 1 AS differs, nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM NULL AS is_p FROM orders")
def distinct_from(spark, sf_dir):
    outputs = [("o_orderkey", "o_orderkey"), ("differs", "o_custkey IS DISTINCT FROM 1"), ("is_p", "nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM NULL")]
    return project(_table(spark, sf_dir, "orders"), outputs)


@query(
    """SELECT p_partkey, regexp_matches(p_name, '^s.*t$') AS matched, regexp_matches(p_name, '(?i)WIDGET') AS widget, NOT regexp_matches(p_name, 'cold') AS not_cold,
    p_brand LIKE 'Brand#1%' AS brand1, p_type ILIKE 'eco%' AS economy FROM part"""
)
def regex_like(spark, sf_dir):
    outputs = [("p_partkey", "p_partkey"), ("matched", "p_name ~ '^s.*t$'"), ("widget", "p_name ~* 'WIDGET'"), ("not_cold", "p_name !~ 'cold'"), ("brand1", "p_brand LIKE 'Brand#1%'"), ("economy", "p_type ILIKE 'eco%'")]
    return project(_table(spark, sf_dir, "part"), outputs)


@query(
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS none,
    CAST(CAST(user_id AS VARCHAR) AS BIGINT) AS same FROM events"""
)
def try_cast_props(spark, sf_dir):
    outputs = [("event_id", "event_id"), ("k", "TRY_CAST(get_json_object(props, '$.k') AS BIGINT)"), ("none", "TRY_CAST(event_type AS BIGINT)"), ("same", "CAST(CAST(user_id AS STRING) AS BIGINT)")]
    return project(_table(spark, sf_dir, "events"), outputs)


@query("SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, (-l_orderkey) // 7 AS neg, l_orderkey % 7 AS r, l_linenumber & 3 AS low, l_orderkey << 2 AS up, xor(l_orderkey, 5) AS x FROM lineitem")
def int_div(spark, sf_dir):
    outputs = [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"), ("q", "l_orderkey / 7"), ("neg", "-l_orderkey / 7"), ("r", "l_orderkey % 7"), ("low", "l_linenumber & 3"), ("up", "l_orderkey << 2"), ("x", "l_orderkey ^ 5")]
    return project(_table(spark, sf_dir, "lineitem"), outputs)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 100000.5 AND (o_orderstatus = 'F' OR nullif(o_custkey, 7) IS NULL)")
def declarative_filter(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").withColumn("maybe", F.nullif("o_custkey", F.lit(7)))
    tree = {"call": "or", "args": [{"call": "eq", "args": [{"col": "o_orderstatus"}, "F"]}, {"call": "is_null", "args": [{"col": "maybe"}]}]}
    return filter_rows(filter_rows(orders, comparison("o_totalprice >= 100000.5")), declared(tree)).select("o_orderkey", "o_orderstatus")


@query(
    """SELECT p_partkey, upper(p_name) AS up, length(p_name)::INT AS n, split_part(p_name, ' ', 1) AS first, left(p_name, 3) AS l3, right(p_name, 3) AS r3, replace(p_name, 'widget', 'w') AS rep,
    reverse(p_name) AS rev, lpad(p_brand, 12, '*') AS padded, strpos(p_name, 'w')::INT AS at, repeat(p_type, 2) AS twice, starts_with(p_name, 'c') AS c, translate(p_name, 'abc', 'xyz') AS tr,
    p_name || '!' AS bang, regexp_replace(p_name, '[aeiou]', '-', 'g') AS vowels, regexp_replace(p_name, '[aeiou]', '-') AS vowel1, len(string_split(p_name, ' '))::INT AS words,
    nullif(p_size, 10) AS nul, coalesce(nullif(p_size, 10), -1) AS co, greatest(p_size, 20) AS gr, abs(p_size - 25) AS ab FROM part"""
)
def string_functions(spark, sf_dir):
    calls = {
        "p_partkey": "p_partkey", "up": "upper(p_name)", "n": "length(p_name)", "first": "split_part(p_name, ' ', 1)", "l3": "left(p_name, 3)", "r3": "right(p_name, 3)", "rep": "replace(p_name, 'widget', 'w')",
        "rev": "reverse(p_name)", "padded": "lpad(p_brand, 12, '*')", "at": "strpos(p_name, 'w')", "twice": "repeat(p_type, 2)", "c": "starts_with(p_name, 'c')", "tr": "translate(p_name, 'abc', 'xyz')",
        "bang": "p_name || '!'", "vowels": "regexp_replace(p_name, '[aeiou]', '-', 'g')", "vowel1": "regexp_replace(p_name, '[aeiou]', '-')", "words": "array_length(string_to_array(p_name, ' '))",
        "nul": "nullif(p_size, 10)", "co": "coalesce(nullif(p_size, 10), -1)", "gr": "greatest(p_size, 20)", "ab": "abs(p_size - 25)",
    }
    return project(_table(spark, sf_dir, "part"), list(calls.items()))


@query(
    """SELECT event_id, date_part('year', ts)::INT AS y, date_part('month', ts)::INT AS m, date_trunc('hour', ts)::TIMESTAMP AS h, (date_part('dow', ts))::INT AS dow, md5(event_type) AS md, sha256(event_type) AS sha,
    lower(hex(event_type)) AS hx, epoch_us(ts)::BIGINT AS us, time_bucket(INTERVAL '15 minutes', ts)::TIMESTAMP AS bin, list_contains(['login', 'click'], event_type) AS known,
    CASE WHEN value > 100 THEN 'big' WHEN value > 50 THEN 'mid' ELSE 'low' END AS size, gcd(user_id, 12)::BIGINT AS g FROM events"""
)
def time_hash_functions(spark, sf_dir):
    calls = {
        "event_id": "event_id", "y": "date_part('year', ts)", "m": "extract(month FROM ts)", "h": "date_trunc('hour', ts)", "dow": "date_part('dow', ts)", "md": "md5(event_type)", "sha": "encode(sha256(event_type), 'hex')",
        "hx": "to_hex(event_type)", "us": "unix_micros(ts::timestamptz)", "bin": "date_bin('15 minutes', ts)::timestamp", "known": "array_has(ARRAY['login', 'click'], event_type)",
        "size": "CASE WHEN value > 100 THEN 'big' WHEN value > 50 THEN 'mid' ELSE 'low' END", "g": "gcd(user_id, 12)",
    }
    return project(_table(spark, sf_dir, "events"), list(calls.items())).withColumn("h", F.col("h").cast("timestamp_ntz"))


@query("SELECT vec_id, len(embedding)::INT AS n, list_max(embedding) > 2 AS any_big, embedding[1]::DOUBLE AS first FROM embeddings")
def array_functions(spark, sf_dir):
    df = _table(spark, sf_dir, "embeddings")
    return df.select("vec_id", scalar("array_length(embedding)", df).alias("n"), scalar("array_max(embedding) > 2", df).alias("any_big"), scalar("CAST(array_element(embedding, 1) AS DOUBLE)", df).alias("first"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
def derive_filter(spark, sf_dir):
    steps = [transforms.Derive("net", "l_extendedprice * (1 - l_discount)"), transforms.Filter("net > 50000"), transforms.Derive("gross", "net * (1 + l_tax)")]
    return transforms.apply_transforms(_table(spark, sf_dir, "lineitem"), steps).select("l_orderkey", "l_linenumber", "net", "gross")


@query("SELECT c_custkey, 'sha256:' || sha256(c_name) AS c_name, NULL::VARCHAR AS c_mktsegment, CASE WHEN c_nationkey IS NOT NULL THEN '***' END AS nation FROM customer")
def redact_hash(spark, sf_dir):
    steps = [transforms.Redact("c_name", "hash"), transforms.Redact("c_mktsegment", "omit"), transforms.Redact("c_nationkey", "mask"), transforms.Rename("c_nationkey", "nation")]
    return transforms.apply_transforms(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), steps)


@query("SELECT conv_id, turn, pos, word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1)::INT - 1 AS pos FROM conversations WHERE text IS NOT NULL)")
def expand_nested(spark, sf_dir):
    df = _table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.split("text", " ").alias("words"))
    out = transforms.apply_transforms(df, [transforms.ExpandNested("words", "child")])
    return out.select("conv_id", "turn", F.col("_ordinal_in_parent").alias("pos"), F.col("_child").alias("word"))


# -- contracts ---------------------------------------------------------------------------------


def _broken(df: DataFrame, rule: C.Rule, *keys: str) -> DataFrame:
    return C.with_violations(df, C.Contract((rule,))).select(*keys, (F.size("violations") > 0).alias("violated"))


@query("SELECT event_id, nullif(event_type, 'error') IS NULL AS violated FROM events")
def rule_nullability(spark, sf_dir):
    df = _table(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("error")))
    return _broken(df, C.Nullability("there", "event_type"), "event_id")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY') NOT IN ('BUILDING', 'FURNITURE'), false) AS violated FROM customer")
def rule_domain(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return _broken(df, C.Domain("known", "c_mktsegment", ("BUILDING", "FURNITURE")), "c_custkey")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    NOT (CASE WHEN l_discount = 0 THEN CAST(l_discount AS VARCHAR) = '0.0' ELSE l_discount IN (0.05, 0.06) END) AS violated FROM lineitem"""
)
def rule_domain_float(spark, sf_dir):
    return _broken(_table(spark, sf_dir, "lineitem"), C.Domain("bits", "l_discount", ("0.0", "0.05", "0.06")), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(l_quantity, 50) < 3 OR nullif(l_quantity, 50) > 45, false) AS violated FROM lineitem")
def rule_range(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(50.0)))
    return _broken(df, C.Range("quantity", "l_quantity", "3", "45"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT p_partkey, NOT regexp_matches(p_name, 'd w') AS violated FROM part")
def rule_regex(spark, sf_dir):
    return _broken(_table(spark, sf_dir, "part"), C.Regex("name", "p_name", "d w"), "p_partkey")


@query("SELECT event_id, ts IS NULL OR (1706745600000 - epoch_us(ts) // 1000) > 864000000 AS violated FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts FROM events)")
def rule_freshness(spark, sf_dir):
    df = _table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 11 != 0, F.col("ts")))
    return _broken(df, C.Freshness("fresh", "ts", 864_000_000, 1_706_745_600_000), "event_id")


_QUARANTINED = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'discount_range' AS rule_id, 'range_violation' AS error_code, 'l_discount' AS "column", CAST(l_discount AS VARCHAR) AS value
FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.09
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'flag_known', 'domain_violation', 'l_returnflag', 'sha256:' || sha256(l_returnflag) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
"""


@query(_QUARANTINED)
def quarantine_rows(spark, sf_dir):
    contract = C.Contract(LINEITEM_CONTRACT.rules, redact={"l_returnflag": "hash"})
    return C.validate(_table(spark, sf_dir, "lineitem"), contract, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).quarantine


_BAD = "(l_discount < 0.01 OR l_discount > 0.09 OR l_returnflag NOT IN ('A', 'N'))"


@query(f"SELECT count(*)::BIGINT AS input_rows, count(*) FILTER (NOT {_BAD})::BIGINT AS accepted_rows, count(*) FILTER ({_BAD})::BIGINT AS quarantined_rows FROM lineitem")
def verdict_summary(spark, sf_dir):
    return C.validate(_table(spark, sf_dir, "lineitem"), LINEITEM_CONTRACT).summary()


@query(
    """SELECT rule_id, coalesce(n, 0)::BIGINT AS violations FROM (VALUES ('orderkey_there'), ('discount_range'), ('flag_known')) v(rule_id) LEFT JOIN (
    SELECT 'discount_range' AS rule_id, count(*) AS n FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.09
    UNION ALL SELECT 'flag_known', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')) USING (rule_id)"""
)
def violations_by_rule(spark, sf_dir):
    return C.validate(_table(spark, sf_dir, "lineitem"), LINEITEM_CONTRACT).violations_by_rule()


# -- dedup and changes ---------------------------------------------------------------------------


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedup_first(spark, sf_dir):
    return keep_one(_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1")
def dedup_last(spark, sf_dir):
    return keep_one(_table(spark, sf_dir, "documents"), ["text"], ["doc_id"], "last").select("doc_id", "lang", "source")


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def dedup_exact(spark, sf_dir):
    return distinct_rows(_table(spark, sf_dir, "events").select("user_id", "event_type", "props"))


@query("SELECT sum(n)::BIGINT AS input_rows, count(*) FILTER (n > 1)::BIGINT AS duplicate_key_count, sum(n - 1)::BIGINT AS dropped_row_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def dedup_counts(spark, sf_dir):
    return dedup_summary(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log keyed by user: signups insert, errors delete, the rest update."""
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", op.alias("op"))


_CHANGES = """SELECT user_id, event_id, ts, value, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op FROM events"""
_REDUCED = f"SELECT * FROM ({_CHANGES}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(f"SELECT user_id, event_id, value, op FROM ({_REDUCED}) WHERE op <> 'delete'")
def cdc_reduce(spark, sf_dir):
    reduced = reduce_changes(_changes(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return split_changes(reduced)[0].select("user_id", "event_id", "value", "op")


def _stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders with a new price, and as many new ones."""
    even = _table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return even.unionByName(even.withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000))


_STAGE = "SELECT o_orderkey + o.k AS o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders, (VALUES (0), (100000000)) o(k) WHERE o_orderkey % 2 = 0"


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, 'kept' AS change FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT *, CASE WHEN o_orderkey >= 100000000 THEN 'inserted' ELSE 'updated' END FROM ({_STAGE})")
def merge_upsert(spark, sf_dir):
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    merged = merged_rows(_table(spark, sf_dir, "orders").select(*columns), _stage(spark, sf_dir), ["o_orderkey"], columns)
    return merged.withColumnRenamed("__change", "change")


@query(f"SELECT count(*) FILTER (o_orderkey >= 100000000)::BIGINT AS inserted, count(*) FILTER (o_orderkey < 100000000)::BIGINT AS updated FROM ({_STAGE})")
def merge_counts(spark, sf_dir):
    return commit_counts(_table(spark, sf_dir, "orders"), _stage(spark, sf_dir), ["o_orderkey"])


def _apply(spark: SparkSession, sf_dir: str, delete: Delete) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"), F.lit(True).alias("gone"))
    reduced = reduce_changes(_changes(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "value", "op")
    columns = ["user_id", "value"] + (["gone"] if delete.policy == "soft" else [])
    return applied_changes(customers, reduced, ["user_id"], columns, "op", delete)


_APPLIED = f"FROM (SELECT c_custkey AS user_id, c_acctbal AS value FROM customer) c FULL OUTER JOIN ({_REDUCED}) r USING (user_id)"


@query(f"SELECT user_id, CASE WHEN r.op IS NULL THEN c.value ELSE r.value END AS value {_APPLIED} WHERE r.op IS DISTINCT FROM 'delete'")
def cdc_apply_hard(spark, sf_dir):
    out = _apply(spark, sf_dir, Delete("hard"))
    return out.where(~F.col("__change").isin("hard_deleted", "missing_delete")).drop("__change")


@query(
    f"""SELECT user_id, CASE WHEN r.op IS NULL OR r.op = 'delete' THEN c.value ELSE r.value END AS value, CASE WHEN r.op IS NULL THEN true ELSE r.op = 'delete' END AS gone {_APPLIED}
    WHERE NOT (r.op IS NOT DISTINCT FROM 'delete' AND c.value IS NULL)"""
)
def cdc_apply_soft(spark, sf_dir):
    out = _apply(spark, sf_dir, Delete("soft", "gone"))
    return out.where(F.col("__change") != "missing_delete").drop("__change")


@query(
    f"""SELECT CASE WHEN r.op IS NULL THEN 'kept' WHEN r.op = 'delete' AND c.value IS NULL THEN 'missing_delete' WHEN r.op = 'delete' THEN 'hard_deleted' WHEN c.value IS NULL THEN 'inserted' ELSE 'updated' END AS change,
    count(*)::BIGINT AS rows {_APPLIED} GROUP BY 1"""
)
def cdc_counts(spark, sf_dir):
    out = _apply(spark, sf_dir, Delete("hard"))
    return out.groupBy(F.col("__change").alias("change")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL {_STAGE}")
def lake_merge(spark, sf_dir):
    """Two packages delivered to a Parquet target: a full load, then a merge."""
    lake = Lake(spark, scratch(spark))
    first = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    lake.deliver("orders", first, "full", "merge", ["o_orderkey"], buckets=16)
    lake.deliver("orders", _stage(spark, sf_dir), "delta", "merge", ["o_orderkey"])
    return lake.read("orders")


@query("SELECT o_orderstatus, count(*)::BIGINT AS rows, round(sum(o_totalprice * 2), 2) AS price FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' GROUP BY 1")
def run_resource(spark, sf_dir):
    """A resource from its text to a checkpoint, run twice under one package id, then read back."""
    sql = """RESOURCE TARGET orders_out DISPOSITION MERGE(o_orderkey) TRUST GOVERNED
        AS SELECT o_orderkey, o_orderstatus, o_totalprice * 2 AS price FROM upstream(source => 'tpch', table => 'orders') WHERE o_totalprice > 1000"""
    root = scratch(spark)
    folder = Folder(spark, root)
    lake, packages, ledger = Lake(spark, root), Packages(spark, f"{root}/packages"), Ledger(folder)
    contract = C.Contract((C.Domain("status", "o_orderstatus", ("F", "O")),))
    for _ in range(2):
        run(spark, sql, Registry({"tpch": parquet_source(sf_dir)}), lake, packages, ledger, Options(contract), package_id="p1")
    return lake.read("orders_out").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("price"), 2).alias("price"))


# -- statistics ----------------------------------------------------------------------------------


def _stats_sql(table: str, columns: list[str], group: str | None = None) -> str:
    head = f"{group} AS segment, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    parts = [f"SELECT {head}'{c}' AS \"column\", count(*)::BIGINT AS row_count, count(*) FILTER ({c} IS NULL)::BIGINT AS null_count, min({c})::VARCHAR AS minimum, max({c})::VARCHAR AS maximum, true AS complete FROM {table}{tail}" for c in columns]
    return " UNION ALL ".join(parts)


@query(_stats_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]))
def column_stats(spark, sf_dir):
    return statistics.profile(_table(spark, sf_dir, "lineitem").drop("l_discount"))


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.with_segment(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), 1000, "event_id", "segment")


_SEGMENTED = "(SELECT event_id // 1000 AS segment, event_id, user_id, event_type, value FROM events)"


@query(f"SELECT * FROM ({_stats_sql(_SEGMENTED, ['event_id', 'user_id', 'event_type', 'value'], 'segment')}) UNION ALL SELECT NULL::BIGINT, * FROM ({_stats_sql('events', ['event_id', 'user_id', 'event_type', 'value'])})")
def segment_stats(spark, sf_dir):
    return statistics.segment_and_package(_segmented(spark, sf_dir), "segment")


@query(f"SELECT segment, CASE WHEN max(event_id) >= 2500 AND min(event_id) < 7000 AND max(value) > 10 THEN 'retained_may_match' ELSE 'pruned' END AS outcome FROM {_SEGMENTED} GROUP BY segment")
def segment_prune(spark, sf_dir):
    profiles = statistics.profile(_segmented(spark, sf_dir), ["segment"])
    kinds = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double"}
    return statistics.prune(profiles, "segment", "event_id >= 2500 AND NOT event_id >= 7000 AND value > 10", kinds)


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 4096 AS segment, o_orderkey FROM orders")
def package_order(spark, sf_dir):
    numbered = segments.with_ordinal(_table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "ordinal")
    return segments.with_segment(numbered, 4096, "ordinal", "segment").select("ordinal", "segment", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25)")
def limit_in_package_order(spark, sf_dir):
    rows = filter_rows(_table(spark, sf_dir, "orders"), "o_orderstatus = 'O'")
    return segments.limit_in_order(rows, ["o_orderkey"], 25).select("o_orderkey", "o_totalprice")


# -- late data, positions, evidence --------------------------------------------------------------------

_ARRIVAL = "(event_id * 7919) % 1000003"


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("epoch", F.floor(F.expr(_ARRIVAL) / 250_000).cast("bigint"))


@query("SELECT min(w) AS watermark FROM (SELECT max(ts) AS w FROM events GROUP BY event_type)")
def watermark_min(spark, sf_dir):
    return late.global_watermark(late.partition_watermarks(_table(spark, sf_dir, "events"), "event_type", "ts"))


_EPOCHS = f"(SELECT *, ({_ARRIVAL}) // 250000 AS epoch FROM events)"


@query(
    f"""WITH e AS (SELECT * FROM {_EPOCHS}), w AS (SELECT min(m) AS watermark FROM (SELECT max(ts) AS m FROM e WHERE epoch = 0 GROUP BY event_type))
    SELECT event_id, coalesce(ts < watermark, false) AS late FROM e, w WHERE epoch >= 1"""
)
def late_split(spark, sf_dir):
    events = _arrivals(spark, sf_dir)
    first = late.partition_watermarks(events.where("epoch = 0"), "event_type", "ts")
    watermark = late.global_watermark(first).first()["watermark"]  # the committed watermark: one value
    split = late.split_late(events.where("epoch >= 1"), "ts", watermark, "admit_with_annotation")
    return split.admitted.select("event_id", F.col(late.LATE).alias("late"))


@query(
    f"""WITH e AS (SELECT * FROM {_EPOCHS}), w AS (SELECT min(m) AS watermark FROM (SELECT max(ts) AS m FROM e WHERE epoch = 0 GROUP BY event_type))
    SELECT event_type, count(*) FILTER (NOT coalesce(ts < watermark, false))::BIGINT AS admitted, count(*) FILTER (coalesce(ts < watermark, false))::BIGINT AS quarantined FROM e, w WHERE epoch >= 1 GROUP BY event_type"""
)
def late_quarantine(spark, sf_dir):
    events = _arrivals(spark, sf_dir)
    watermark = late.global_watermark(late.partition_watermarks(events.where("epoch = 0"), "event_type", "ts")).first()["watermark"]
    split = late.split_late(events.where("epoch >= 1"), "ts", watermark, "quarantine")
    both = split.admitted.select("event_type", F.lit("a").alias("k")).unionByName(split.quarantined.select("event_type", F.lit("q").alias("k")))
    count = lambda k: F.count(F.when(F.col("k") == k, 1))
    return both.groupBy("event_type").agg(count("a").alias("admitted"), count("q").alias("quarantined"))


@query("SELECT event_type, count(*)::BIGINT AS rows FROM events GROUP BY event_type")
def drain_epochs(spark, sf_dir):
    """events as a stream, drained in epochs of 4,000 rows or more into a target; late rows are marked, so none is lost."""
    from sluice.plans.resource import Execution
    from sluice.streaming.epochs import Drain, EpochState

    root = scratch(spark)
    lake = Lake(spark, root)
    execution = Execution("drain", ("batches", 1), ("rows", 4000), ("quiescent", 0), "admit_with_annotation", "ts")
    state = EpochState(spark, f"{root}/state")

    def settle(rows: DataFrame, late_rows: DataFrame, epoch: int, watermark) -> int:
        return lake.deliver("events", rows.select("event_id", "event_type"), f"epoch-{epoch}", "append").counts["rows_written"]

    table = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "*.parquet").parquet(table if _is_folder(spark, table) else f"{sf_dir}/[e]vents.parquet")
    Drain(execution, settle, state, "event_type", "ts").run(stream, f"{root}/stream")
    return lake.read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    return bool(Folder(spark, path).glob("*.parquet"))


@query("SELECT path, identity FROM (VALUES ('a', '1:1'), ('b', '2:5'), ('c', '3:1')) n(path, identity) ANTI JOIN (VALUES ('a', '1:1'), ('b', '2:4'), ('d', '9:9')) o(path, identity) USING (path, identity)")
def manifest_changed(spark, sf_dir):
    now = spark.createDataFrame([("a", "1:1"), ("b", "2:5"), ("c", "3:1")], "path string, identity string")
    return changed_files(now, spark.createDataFrame([("a", "1:1"), ("b", "2:4"), ("d", "9:9")], "path string, identity string"))


@query(
    """SELECT o_orderkey, CASE WHEN d.p IS NULL THEN 'missing_in_destination' WHEN l.p IS NULL THEN 'unknown_to_ledger' WHEN d.p = l.p THEN 'match' ELSE 'differs' END AS state
    FROM (SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_orderkey % 5 <> 0) l
    FULL OUTER JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 7 <> 0) d USING (o_orderkey)"""
)
def drift_full_outer(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"))
    destination = orders.where("o_orderkey % 7 <> 0").withColumn("p", F.when(F.col("o_orderkey") % 3 == 0, F.col("p") + 1).otherwise(F.col("p")))
    return drift(orders.where("o_orderkey % 5 <> 0"), destination, ["o_orderkey"], "p")


@query("SELECT user_id AS scope, max(event_id) AS sequence, arg_max(value, event_id) AS position FROM events WHERE event_type <> 'error' GROUP BY user_id")
def head_checkpoint(spark, sf_dir):
    log = _table(spark, sf_dir, "events").where("event_type <> 'error'")
    return log.groupBy(F.col("user_id").alias("scope")).agg(F.max("event_id").alias("sequence"), F.max_by("value", "event_id").alias("position"))


@query("SELECT user_id AS scope, event_id AS sequence, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent FROM events")
def checkpoint_parents(spark, sf_dir):
    from pyspark.sql import Window as W

    parent = F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_id").alias("sequence"), parent.alias("parent"))


@query(
    """SELECT user_id::VARCHAR AS resource_id, count(*) FILTER (event_id > coalesce(last_bad, -1))::BIGINT AS clean_runs
    FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_bad FROM events) GROUP BY user_id"""
)
def clean_run_streak(spark, sf_dir):
    runs = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("resource_id"), F.col("event_id").alias("sequence"), (F.col("event_type") == "error").cast("int").alias("quarantined_rows"))
    return clean_streaks(runs)


_FRESH = """SELECT user_id::VARCHAR AS resource_id, 1706745600000 - max(epoch_us(ts) // 1000) AS age_ms,
    CASE WHEN user_id % 5 = 0 THEN 'non_evaluable' WHEN 1706745600000 - max(epoch_us(ts) // 1000) > 172800000 THEN 'stale' ELSE 'fresh' END AS status FROM events GROUP BY user_id"""


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _table(spark, sf_dir, "events").schema["ts"].dataType
    seen = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(C.epoch_millis(F.col("ts"), kind)).alias("last_ms"))
    objective = F.when(F.col("user_id") % 5 != 0, F.lit(172_800_000).cast("bigint"))
    return freshness(seen.select(F.col("user_id").cast("string").alias("resource_id"), "last_ms", objective.alias("max_age_ms")), 1_706_745_600_000)


@query(_FRESH)
def freshness_status(spark, sf_dir):
    return _freshness(spark, sf_dir)


@query(f"SELECT count(*)::BIGINT AS total, count(*) FILTER (status = 'fresh')::BIGINT AS fresh, count(*) FILTER (status = 'stale')::BIGINT AS stale, count(*) FILTER (status = 'non_evaluable')::BIGINT AS non_evaluable FROM ({_FRESH})")
def freshness_counts(spark, sf_dir):
    return freshness_summary(_freshness(spark, sf_dir))


@query("SELECT 'string:' || o_orderstatus AS route, count(*)::BIGINT AS rows FROM orders GROUP BY 1")
def route_counts(spark, sf_dir):
    return routing.route_counts(_table(spark, sf_dir, "orders"), "o_orderstatus", 3)


@query("SELECT (o_orderkey // 1000) * 1000 AS start, (o_orderkey // 1000) * 1000 + 1000 AS stop, count(*)::BIGINT AS rows FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1, 2")
def backfill(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").where("o_orderkey IS NOT NULL").select(F.expr("o_orderkey div 1000 * 1000").alias("start"))
    low, high = orders.agg(F.min("start"), F.max("start")).first()
    # the windows that the table's own keys span, made in the executors; one row a window
    starts = spark.range(0) if low is None else spark.range(low, high + 1, 1000)
    windows = starts.select(F.col("id").alias("start"), (F.col("id") + 1000).alias("stop"))
    return orders.groupBy("start").agg(F.count(F.lit(1)).alias("rows")).join(windows, "start").select("start", "stop", "rows")


# -- schema and residuals ---------------------------------------------------------------------------------


@query(
    """SELECT event_id, user_id::DECIMAL(25,2) AS user_id, NULL::VARCHAR AS country,
    '{"v":1,"fields":{"/event_type":{"arrow_type":"string","encoding":"text","value":"' || event_type || '"},"/value":{"arrow_type":"double","encoding":"text","value":"' || value::VARCHAR || '"}}}' AS _variant FROM events"""
)
def residual_capture(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    kept = residual.capture(events, ["event_id", "user_id"])
    want = T.StructType.fromDDL("event_id bigint, user_id decimal(25,2), country string, _variant string")
    return schema.conform(kept, want)[0]


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events")
def residual_promotion(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    captured = residual.capture(events.select("event_id", "value"), ["event_id"])
    return residual.promote(captured, "/value", "value", "double").select("event_id", "value")


@query("SELECT key, amount, note FROM (SELECT o_orderkey::BIGINT AS key, o_totalprice::DOUBLE AS amount, NULL::VARCHAR AS note FROM orders UNION ALL SELECT l_linenumber::BIGINT, l_quantity::FLOAT::DOUBLE, l_returnflag FROM lineitem)")
def schema_union(spark, sf_dir):
    a = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    b = _table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("key"), F.col("l_quantity").cast("float").alias("amount"), F.col("l_returnflag").alias("note"))
    return schema.union_files({"a.parquet": a, "b.parquet": b})


@query("SELECT c_custkey AS customer_key, c_acctbal AS http_balance_eur, c_name AS straenname FROM customer".replace("straenname", "stra_e"))
def normalize_names(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("CustomerKey"), F.col("c_acctbal").alias("HTTPBalance (EUR)"), F.col("c_name").alias("Straße"))
    return schema.normalize_columns(df)


# -- table formats ------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id FROM (SELECT *, event_id % 4 AS f, event_id // 4 AS p FROM events) WHERE NOT (f = 1 AND p % 3 = 0)")
def position_deletes(spark, sf_dir):
    data = _table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("concat('f', event_id % 4)").alias("_file"), F.expr("event_id div 4").alias("_pos"), F.lit(5).alias("_sequence"))
    gone = data.where("_file = 'f1' and _pos % 3 = 0").select(F.col("_file").alias("file"), F.col("_pos").alias("pos"), F.lit(5).alias("sequence"))
    return apply_position_deletes(data, gone).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE NOT (user_id % 2 = 0 AND event_id < 500)")
def equality_deletes(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    data = events.select("event_id", "user_id", F.when(F.col("event_id") < 500, 1).otherwise(9).alias("_sequence"))
    gone = events.select("user_id").where("user_id % 2 = 0").distinct().withColumn("sequence", F.lit(5))
    return apply_equality_deletes(data, gone, ["user_id"]).select("event_id", "user_id")


# -- extensions: relational SQL ----------------------------------------------------------------------------------


@query(
    """SELECT n_name, l_returnflag, count(*)::BIGINT AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, rank() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, n_name)::INT AS place
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, l_returnflag"""
)
def ext_join_aggregate_window(spark, sf_dir):
    from pyspark.sql import Window as W

    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    # counted by key before names are joined on: fewer rows meet the last join
    counted = joined.groupBy("c_nationkey", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.sum("net").alias("net"))
    named = counted.join(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    by_name = named.groupBy("n_name", "l_returnflag").agg(F.sum("lines").alias("lines"), F.round(F.sum("net"), 2).alias("revenue"))
    return by_name.withColumn("place", F.rank().over(W.partitionBy("l_returnflag").orderBy(F.desc("lines"), "n_name")))


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS orders, max(o_totalprice) AS most FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark, sf_dir):
    return _table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("most"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS events, max(value) AS most FROM events GROUP BY 1, 2")
def ext_tumbling_window(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    grouped = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("most"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "most")


# the other modules register theirs
from sluice.plans import catalog_language, catalog_rules, catalog_sources  # noqa: E402, F401

__all__ = ["ORACLE_SQL", "QUERIES"]
