"""Queries of the resource language: expressions, admission, functions, transforms, order and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.expressions import declared, filter_rows, project, scalar
from sluice.operators import segments, transforms
from sluice.operators.contract import Contract, Nullability
from sluice.plans.frontend import parse_resource
from sluice.plans.registration import decisions, outcome, query, table, values
from sluice.plans.resource import SOURCES, pushdown, pushes_limit
from sluice.plans.run import Options, Registry, parquet_source, plan

# -- expressions

_NULLABLE = "CASE WHEN value > 50 THEN true WHEN value < 20 THEN false END"
_OTHER = "CASE event_type WHEN 'click' THEN true WHEN 'login' THEN false END"


@query(
    f"""SELECT event_id, a AND b AS both, a OR b AS either, NOT a AS negated, a IS NULL AS a_null, (a AND b) IS NOT NULL AS known
    FROM (SELECT event_id, {_NULLABLE} AS a, {_OTHER} AS b FROM events)"""
)
def kleene_logic(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr(_NULLABLE).alias("a"), F.expr(_OTHER).alias("b"))
    outputs = [("event_id", "event_id"), ("both", "a AND b"), ("either", "a OR b"), ("negated", "NOT a"), ("a_null", "a IS NULL"), ("known", "(a AND b) IS NOT NULL")]
    return project(events, outputs)


_TREES = {
    "eq": {"call": "eq", "args": [{"col": "o_orderstatus"}, "F"]},
    "neq": {"call": "neq", "args": [{"col": "o_orderstatus"}, "F"]},
    "gt": {"call": "gt", "args": [{"col": "o_totalprice"}, 100000.5]},
    "gte": {"call": "gte", "args": [{"col": "o_custkey"}, 50]},
    "lt": {"call": "lt", "args": [{"col": "o_totalprice"}, 100000.5]},
    "lte": {"call": "lte", "args": [{"col": "o_custkey"}, 50]},
    "conj": {"call": "and", "args": [{"call": "eq", "args": [{"col": "o_orderstatus"}, "O"]}, {"call": "not", "args": [{"call": "is_null", "args": [{"col": "maybe"}]}]}]},
    "disj": {"call": "or", "args": [{"call": "is_null", "args": [{"col": "maybe"}]}, {"call": "is_not_null", "args": [{"col": "o_orderkey"}]}]},
}


@query(
    """SELECT o_orderkey, o_orderstatus = 'F' AS eq, o_orderstatus <> 'F' AS neq, o_totalprice > 100000.5 AS gt, o_custkey >= 50 AS gte, o_totalprice < 100000.5 AS lt, o_custkey <= 50 AS lte,
    o_orderstatus = 'O' AND nullif(o_custkey, 7) IS NOT NULL AS conj, true AS disj FROM orders"""
)
def declared_calls(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("maybe", F.nullif("o_custkey", F.lit(7)))
    return orders.select("o_orderkey", *[declared(tree).alias(name) for name, tree in _TREES.items()])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -l_quantity AS minus, NOT (l_quantity > 10) AS small, l_comment IS NULL AS no_comment, l_tax IS NOT NULL AS taxed FROM (SELECT *, nullif(l_returnflag, 'N') AS l_comment FROM lineitem)")
def unary_operators(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("l_comment", F.nullif("l_returnflag", F.lit("N")))
    keys = [(k, k) for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return project(lines, [*keys, ("minus", "-l_quantity"), ("small", "NOT (l_quantity > 10)"), ("no_comment", "l_comment IS NULL"), ("taxed", "l_tax IS NOT NULL")])


@query("SELECT p_partkey, p_name LIKE '%widget%' AS a, p_name ILIKE '%WIDGET' AS b, p_name NOT LIKE 's%' AS c, p_name NOT ILIKE 'S_____%' AS d FROM part")
def like_operators(spark, sf_dir):
    return project(table(spark, sf_dir, "part"), [("p_partkey", "p_partkey"), ("a", "p_name LIKE '%widget%'"), ("b", "p_name ILIKE '%WIDGET'"), ("c", "p_name NOT LIKE 's%'"), ("d", "p_name NOT ILIKE 'S_____%'")])


@query("SELECT o_orderkey, o_orderkey & 12 AS conj, o_orderkey | 3 AS disj, xor(o_orderkey, 10) AS either, o_orderkey << 3 AS up, o_orderkey >> 2 AS down FROM orders")
def bitwise_operators(spark, sf_dir):
    return project(table(spark, sf_dir, "orders"), [("o_orderkey", "o_orderkey"), ("conj", "o_orderkey & 12"), ("disj", "o_orderkey | 3"), ("either", "o_orderkey ^ 10"), ("up", "o_orderkey << 3"), ("down", "o_orderkey >> 2")])


@query("SELECT c_custkey, c_name || '/' || nullif(c_mktsegment, 'BUILDING') AS label FROM customer")
def text_concatenation(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return project(customers, [("c_custkey", "c_custkey"), ("label", "c_name || '/' || segment")])


@query(
    """SELECT p_partkey, list_has_all(words, ['widget']) AS has_widget, list_has_all(['cold', 'widget', 'small'], words) AS within, list_has_all(words, []) AS nothing
    FROM (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)"""
)
def list_containment(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return project(parts, [("p_partkey", "p_partkey"), ("has_widget", "words @> ARRAY['widget']"), ("within", "words <@ ARRAY['cold', 'widget', 'small']"), ("nothing", "array_length(array_except(make_array(), words)) = 0")])


@query("SELECT c_custkey AS key, c_name, c_acctbal AS balance, c_acctbal AS again FROM customer")
def pass_through_columns(spark, sf_dir):
    return project(table(spark, sf_dir, "customer"), [("key", "c_custkey"), ("c_name", "c_name"), ("balance", "c_acctbal"), ("again", "c_acctbal")])


_PREDICATES = [("o_totalprice > 5", "ok"), ("o_orderstatus = 'F'", "ok"), ("NOT (o_custkey = 1)", "ok"), ("o_custkey IS NULL", "ok"), ("o_totalprice", "ContractError"), ("o_custkey + 1", "ContractError"), ("upper(o_orderstatus)", "ContractError"), ("true", "ok")]


@query(values(_PREDICATES, "predicate, outcome"))
def filters_are_boolean(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return decisions(spark, [(p, outcome(lambda p=p: filter_rows(orders, p))) for p, _ in _PREDICATES], "predicate string, outcome string")


_ADMISSION = [
    ("abs(o_custkey)", "ok"), ("coalesce(o_orderstatus, 'x')", "ok"), ("sha256(o_orderstatus)", "ok"), ("regexp_like(o_orderstatus, 'F')", "ok"), ("nullif(o_custkey, 1)", "ok"), ("date_part('year', o_orderdate)", "ok"),
    ("random()", "AdmissionError"), ("rand()", "AdmissionError"), ("uuid()", "AdmissionError"), ("now()", "AdmissionError"), ("current_date()", "AdmissionError"), ("current_timestamp()", "AdmissionError"),
    ("my_function(o_custkey)", "AdmissionError"), ("sum(o_custkey)", "AdmissionError"), ("row_number()", "AdmissionError"), ("abs(o_custkey, 2)", "AdmissionError"), ("no_such_column", "AdmissionError"),
]


@query(values(_ADMISSION, "expression, outcome"))
def admitted_functions(spark, sf_dir):
    """Immutable built-ins are admitted; volatile, aggregate, window and unknown functions are not."""
    orders = table(spark, sf_dir, "orders")
    return decisions(spark, [(e, outcome(lambda e=e: scalar(e, orders))) for e, _ in _ADMISSION], "expression string, outcome string")


_STATEMENTS = [
    ("SELECT o_orderkey FROM upstream(source => 't', table => 'orders')", "ok"),
    ("SELECT o_orderkey FROM upstream(source => 't', table => 'orders') WHERE o_totalprice > 5", "ok"),
    ("SELECT o_orderkey FROM orders", "AdmissionError"),
    ("SELECT o_orderkey FROM upstream(source => 't', table => 'orders') JOIN customer ON true", "AdmissionError"),
    ("SELECT o_custkey FROM upstream(source => 't', table => 'orders') GROUP BY o_custkey", "AdmissionError"),
    ("SELECT o_custkey FROM upstream(source => 't', table => 'orders') HAVING true", "AdmissionError"),
    ("SELECT o_custkey FROM upstream(source => 't', table => 'orders') ORDER BY o_custkey", "AdmissionError"),
    ("SELECT o_custkey FROM upstream(source => 't', table => 'orders') LIMIT 5", "AdmissionError"),
    ("SELECT DISTINCT o_custkey FROM upstream(source => 't', table => 'orders')", "AdmissionError"),
    ("SELECT o_custkey FROM upstream(source => 't', table => 'orders') UNION ALL SELECT 1 AS x", "AdmissionError"),
    ("WITH a AS (SELECT 1 AS x) SELECT x FROM a", "AdmissionError"),
    ("SELECT (SELECT 1) AS x FROM upstream(source => 't', table => 'orders')", "AdmissionError"),
    ("SELECT o_custkey IN (SELECT 1) AS x FROM upstream(source => 't', table => 'orders')", "AdmissionError"),
]


@query(values(_STATEMENTS, "statement, outcome"))
def refused_statements(spark, sf_dir):
    """Joins, grouping, ordering, limits, set operations and subqueries are refused before a source is opened."""
    return decisions(spark, [(s, outcome(lambda s=s: parse_resource(f"RESOURCE TRUST GOVERNED AS {s}"))) for s, _ in _STATEMENTS], "statement string, outcome string")


# -- the order of filters, projection, transforms


@query("SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity >= 10 AND l_extendedprice * (1 - l_discount) < 40000 AND l_partkey % 2 = 0 AND l_orderkey IS NOT NULL")
def residual_filters(spark, sf_dir):
    """What a source does not filter exactly is filtered after it, and declared filters see the outputs; the last projection drops what only they needed."""
    sql = "RESOURCE TRUST GOVERNED AS SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM upstream(source => 't', table => 'lineitem') WHERE l_quantity >= 10"
    contract = Contract((Nullability("key", "l_orderkey"),))
    options = Options(contract, filters=("net < 40000", "l_partkey % 2 = 0"), transforms=(transforms.Derive("net", "round(net, 4)"), transforms.Derive("spare", "l_partkey + 1")), select=("l_orderkey", "l_partkey", "net"))
    return plan(spark, parse_resource(sql), Registry({"t": parquet_source(sf_dir)}), options).accepted


@query("SELECT c_custkey AS customer, c_nationkey, upper(c_name) AS c_name FROM customer")
def rename_transform(spark, sf_dir):
    steps = [transforms.Rename("c_custkey", "customer"), transforms.Derive("c_name", "upper(c_name)")]
    return transforms.apply_transforms(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name"), steps)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, floor(l_quantity)::INT AS l_quantity, l_tax::VARCHAR AS l_tax FROM (SELECT *, l_tax + 0.5 AS t FROM lineitem)")
def cast_transform(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.floor("l_quantity").cast("double").alias("l_quantity"), F.col("l_tax").cast("string").alias("l_tax"))
    return transforms.apply_transforms(lines, [transforms.Cast("l_linenumber", "bigint"), transforms.Cast("l_quantity", "int", lossy_allowed=True)])


_CASTS = [("l_linenumber", "bigint", False, "ok"), ("l_quantity", "int", False, "ContractError"), ("l_quantity", "int", True, "ok"), ("l_returnflag", "double", False, "ok"), ("l_returnflag", "binary", False, "ContractError"), ("l_orderkey", "decimal(21,2)", False, "ok")]


@query(values(_CASTS, '"column", "to", lossy_allowed, outcome'))
def cast_transform_rules(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_quantity", "l_returnflag", F.col("l_orderkey").cast("bigint").alias("l_orderkey"))
    return decisions(spark, [(c, to, lossy, outcome(lambda c=c, to=to, lossy=lossy: transforms.apply_transforms(lines, [transforms.Cast(c, to, lossy)]))) for c, to, lossy, _ in _CASTS], "column string, to string, lossy_allowed boolean, outcome string")


@query("SELECT p_partkey, len(words)::INT AS n, '[' || list_aggregate(list_transform(words, lambda w: '\"' || w || '\"'), 'string_agg', ',') || ']' AS text FROM (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)")
def nested_policies(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.split("p_name", " ").alias("text"))
    out = transforms.apply_transforms(parts, [transforms.ExpandNested("words", "keep"), transforms.ExpandNested("text", "variant")])
    return out.select("p_partkey", F.size("words").alias("n"), "text")


# -- what sources do themselves

_OPS = ("=", "!=", "<", "<=", ">", ">=")


@query(
    """SELECT s.name AS source, o.op, CASE WHEN s.name IN ('text', 'iceberg', 'mongodb_changes') THEN 'unsupported' WHEN s.name IN ('parquet', 'glue') THEN 'exact' WHEN s.name = 'rest' THEN CASE WHEN o.op IN ('=', '>', '>=') THEN 'inexact' ELSE 'unsupported' END
    WHEN o.op = '!=' THEN 'unsupported' WHEN s.name = 'sqlite' THEN 'inexact' ELSE 'exact' END AS fidelity
    FROM (VALUES ('parquet'), ('text'), ('postgres'), ('mysql'), ('sqlite'), ('clickhouse'), ('mongodb'), ('mongodb_changes'), ('rest'), ('iceberg'), ('glue')) s(name), (VALUES ('='), ('!='), ('<'), ('<='), ('>'), ('>=')) o(op)"""
)
def pushdown_fidelity(spark, sf_dir):
    return decisions(spark, [(name, op, pushdown(sheet, op)) for name, sheet in SOURCES.items() for op in _OPS], "source string, op string, fidelity string")


@query(
    """SELECT s.name AS source, o.op, c.cursor, (s.name IN ('postgres', 'mysql') OR (s.name IN ('clickhouse', 'mongodb') AND NOT c.cursor)) AND o.op <> '!=' AS pushed
    FROM (VALUES ('parquet'), ('text'), ('postgres'), ('mysql'), ('sqlite'), ('clickhouse'), ('mongodb'), ('mongodb_changes'), ('rest'), ('iceberg'), ('glue')) s(name), (VALUES ('='), ('!='), ('>')) o(op), (VALUES (true), (false)) c(cursor)"""
)
def limit_pushdown(spark, sf_dir):
    """A limit goes to the source only where every filter is exact."""
    return decisions(spark, [(name, op, cursor, pushes_limit(sheet, [op], cursor)) for name, sheet in SOURCES.items() for op in ("=", "!=", ">") for cursor in (True, False)], "source string, op string, cursor boolean, pushed boolean")


@query("SELECT name AS source, name IN ('postgres', 'mysql', 'sqlite', 'clickhouse', 'mongodb') AS orders FROM (VALUES ('parquet'), ('text'), ('postgres'), ('mysql'), ('sqlite'), ('clickhouse'), ('mongodb'), ('mongodb_changes'), ('rest'), ('iceberg'), ('glue')) s(name)")
def source_ordering(spark, sf_dir):
    return decisions(spark, [(name, sheet.order) for name, sheet in SOURCES.items()], "source string, orders boolean")


@query("SELECT c_nationkey, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def mounted_view(spark, sf_dir):
    """A source as a view for any Spark SQL; filter and columns reach its scan."""
    Registry({"t": parquet_source(sf_dir)}).mount(spark, "sluice_mounted", "t", table="customer")
    return spark.sql("SELECT c_nationkey, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM sluice_mounted WHERE c_acctbal > 0 GROUP BY c_nationkey")


# -- order and limits


@query("SELECT 0::BIGINT AS opened, count(*)::BIGINT AS rows FROM orders WHERE false")
def zero_limit(spark, sf_dir):
    """No rows are asked for, and none are read."""
    limited = segments.limit_in_order(table(spark, sf_dir, "orders"), ["o_orderkey"], 0)
    files = limited._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    return limited.agg(F.lit(files).cast("bigint").alias("opened"), F.count(F.lit(1)).alias("rows"))


@query("SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS ordinal FROM events")
def keyed_sort(spark, sf_dir):
    """Effects in the order of their key and position, sorted in ranges that may spill, numbered without a global window."""
    return segments.with_ordinal(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"], "ordinal").select("user_id", "event_id", "ordinal")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def canonical_reorder(spark, sf_dir):
    """Rows that a source gives in no order get the package's."""
    shuffled = table(spark, sf_dir, "orders").select("o_orderkey").repartition(7, F.hash("o_orderkey"))
    return segments.with_ordinal(shuffled, ["o_orderkey"], "ordinal")


@query("SELECT event_type, least(count(*), 5)::BIGINT AS picked FROM events GROUP BY event_type")
def stratified_selection(spark, sf_dir):
    """The same few of each stratum each time."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id")
    once, again = (segments.stratified(e, "event_type", "event_id", 5, seed=3) for e in (events, events.repartition(3)))
    return once.join(again, ["event_type", "event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("picked"))


@query("SELECT batch, bytes, ((sum(bytes) OVER (ORDER BY batch))::BIGINT - bytes) // 1000000 AS segment FROM (SELECT o_orderkey // 100 AS batch, sum(floor(o_totalprice)::BIGINT)::BIGINT AS bytes FROM orders GROUP BY 1)")
def segments_of_bytes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    sizes = orders.groupBy(F.expr("o_orderkey div 100").alias("batch")).agg(F.sum(F.floor("o_totalprice").cast("bigint")).alias("bytes"))
    return segments.segments_by_bytes(sizes, 1_000_000).select("batch", "bytes", "segment")


# -- functions by family


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_quantity - 25) AS a, ceil(l_extendedprice / 7)::BIGINT AS c, floor(l_extendedprice / 7)::BIGINT AS f, sqrt(l_quantity) AS s, power(l_quantity, 2) AS p, sign(l_quantity - 25) AS g,
    greatest(l_quantity, 20) AS hi, least(l_quantity, 20) AS lo, l_orderkey % 7 AS m, lcm(l_linenumber, 6)::BIGINT AS l, trunc(l_extendedprice / 7) AS t, round(ln(l_quantity), 9) AS n, round(log10(l_quantity), 9) AS d, isnan(l_tax) AS nan, l_linenumber = 0 AS z FROM lineitem"""
)
def math_functions(spark, sf_dir):
    calls = {
        "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "a": "abs(l_quantity - 25)", "c": "ceil(l_extendedprice / 7)", "f": "floor(l_extendedprice / 7)", "s": "sqrt(l_quantity)",
        "p": "power(l_quantity, 2)", "g": "sign(l_quantity - 25)", "hi": "greatest(l_quantity, 20)", "lo": "least(l_quantity, 20)", "m": "mod(l_orderkey, 7)", "l": "lcm(l_linenumber, 6)", "t": "trunc(l_extendedprice / 7)",
        "n": "round(ln(l_quantity), 9)", "d": "round(log10(l_quantity), 9)", "nan": "isnan(l_tax)", "z": "iszero(l_linenumber)",
    }
    return project(table(spark, sf_dir, "lineitem"), list(calls.items())).withColumn("g", F.col("g").cast("tinyint"))


@query(
    """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS n, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c, ifnull(nullif(c_nationkey, 3), -1) AS i, CASE WHEN nullif(c_nationkey, 3) IS NOT NULL THEN 'known' ELSE 'unknown' END AS k,
    CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS b, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS p FROM customer"""
)
def conditional_functions(spark, sf_dir):
    calls = {
        "c_custkey": "c_custkey", "n": "nullif(c_mktsegment, 'BUILDING')", "c": "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')", "i": "ifnull(nullif(c_nationkey, 3), -1)", "k": "nvl2(nullif(c_nationkey, 3), 'known', 'unknown')",
        "b": "CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END", "p": "if(c_acctbal > 0, 1, 0)",
    }
    return project(table(spark, sf_dir, "customer"), list(calls.items()))


@query("SELECT c_custkey, lower(hex(c_name)) AS h, rtrim(to_base64(c_name::BLOB), '=') AS b, decode(unhex(hex(c_name))) AS back, sha256(c_name) AS s, md5(c_name) AS m FROM customer")
def encoding_functions(spark, sf_dir):
    calls = {"c_custkey": "c_custkey", "h": "encode(c_name, 'hex')", "b": "encode(c_name, 'base64')", "back": "CAST(decode(encode(c_name, 'hex'), 'hex') AS STRING)", "s": "encode(digest(c_name, 'sha256'), 'hex')", "m": "md5(c_name)"}
    return project(table(spark, sf_dir, "customer"), list(calls.items()))


@query(
    """SELECT p_partkey, regexp_matches(p_name, '[aeiou]{2}') AS l, regexp_replace(p_name, '(\\w+) (\\w+)', '\\2 \\1') AS r, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS c, regexp_extract(p_name, '^(\\w+)', 1) AS x,
    regexp_replace(p_name, 'WIDGET', 'gadget', 'i') AS i FROM part"""
)
def regex_functions(spark, sf_dir):
    calls = {"p_partkey": "p_partkey", "l": "regexp_like(p_name, '[aeiou]{2}')", "r": "regexp_replace(p_name, '(\\w+) (\\w+)', '\\2 \\1')", "c": "regexp_count(p_name, '[aeiou]')", "x": "regexp_extract(p_name, '^(\\w+)', 1)", "i": "regexp_replace(p_name, 'WIDGET', 'gadget', 'i')"}
    return project(table(spark, sf_dir, "part"), list(calls.items()))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS nothing FROM events")
def json_functions(spark, sf_dir):
    return project(table(spark, sf_dir, "events"), [("event_id", "event_id"), ("k", "get_json_object(props, '$.k')"), ("nothing", "get_json_object(props, '$.none')")])


@query("SELECT doc_id, length(text)::INT AS n, strlen(text)::INT AS bytes, left(text, 7) AS l, right(text, 5) AS r, left(text, greatest(length(text) - 3, 0)) AS most, strpos(text, 'é')::INT AS at, reverse(left(text, 7)) AS rev FROM documents")
def unicode_functions(spark, sf_dir):
    calls = {"doc_id": "doc_id", "n": "char_length(text)", "bytes": "octet_length(text)", "l": "left(text, 7)", "r": "right(text, 5)", "most": "left(text, -3)", "at": "strpos(text, 'é')", "rev": "reverse(left(text, 7))"}
    return project(table(spark, sf_dir, "documents"), list(calls.items()))


@query(
    """SELECT p_partkey, array_to_string(list_sort(words), ',') AS sorted, list_contains(words, 'widget') AS has, list_position(words, 'widget')::BIGINT AS at, array_to_string(list_reverse(words), '-') AS back, words[1] AS first, len(list_distinct(list_concat(words, words)))::INT AS d,
    array_to_string(words[1:2], ',') AS two FROM (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)"""
)
def nested_functions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    calls = {
        "p_partkey": "p_partkey", "sorted": "array_to_string(array_sort(words), ',')", "has": "array_has(words, 'widget')", "at": "array_position(words, 'widget')", "back": "array_to_string(array_reverse(words), '-')", "first": "array_element(words, 1)",
        "d": "array_length(array_distinct(array_concat(words, words)))", "two": "array_to_string(array_slice(words, 1, 2), ',')",
    }
    return project(parts, list(calls.items())).withColumn("at", F.nullif("at", F.lit(0)))
