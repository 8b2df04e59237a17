"""The resource language and scalar expressions: what they admit, mean and refuse."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sluice.errors import AdmissionError, ContractError, SluiceError
from sluice.functions.expressions import comparison, declared, filter_rows, parse_comparison, project, scalar
from sluice.functions.sqltext import columns_of, parse_scalar
from sluice.plans.frontend import parse_resource


@pytest.fixture(scope="module")
def one(spark):
    row = [(7, 2, -7.5, "Alpha b,c", None, [1, 2, 3], bytearray(b"abc"), None)]
    return spark.createDataFrame(row, "a int, b int, d double, s string, n string, arr array<int>, bin binary, nb boolean")


@pytest.mark.parametrize(
    ("sql", "value"),
    [
        ("a / b", 3), ("-a / b", -3), ("d / b", -3.75), ("a % b", 1), ("a & b", 2), ("a ^ b", 5), ("a << b", 28), ("a - b - 1", 4), ("2 + 3 * 4", 14), ("(2 + 3) * 4", 20),
        ("s ~ 'b,'", True), ("s ~* 'ALPHA'", True), ("s !~ 'b,'", False), ("s || '!'", "Alpha b,c!"), ("n IS DISTINCT FROM s", True), ("n IS NULL AND nb", None), ("nb AND FALSE", False),
        ("nb OR TRUE", True), ("a IN (1, 7)", True), ("a NOT BETWEEN 1 AND 6", True), ("NOT a = 7", False), ("CASE a WHEN 7 THEN 'x' ELSE 'y' END", "x"), ("TRY_CAST('bad' AS INT)", None), ("'42'::bigint + 1", 43),
        ("string_to_array(s, ',')", ["Alpha b", "c"]), ("string_to_array('a.b', '.')", ["a", "b"]), ("array_length(arr)", 3), ("arr @> ARRAY[1, 2]", True), ("arr <@ ARRAY[1, 2]", False),
        ("encode(bin, 'hex')", "616263"), ("encode(decode('YWJj', 'base64'), 'hex')", "616263"), ("nullif(a, 7)", None), ("left(s, -2)", "Alpha b"), ("right(s, 3)", "b,c"), ("gcd(12, 18)", 6), ("lcm(4, 6)", 12),
        ("regexp_replace(s, '[a-z]', 'X')", "AXpha b,c"), ("regexp_replace(s, '([a-z])', '<\\1>', 'g')", "A<l><p><h><a> <b>,<c>"), ("regexp_match(s, '(\\w+) (\\w)')", ["Alpha", "b"]), ("'it''s'", "it's"),
    ],
)
def test_value(one, sql, value):
    assert one.select(scalar(sql, one).alias("x")).first()["x"] == value


@pytest.mark.parametrize(
    "sql", ["random()", "now()", "current_date", "sum(a)", "count(*)", "(SELECT 1)", "a IN (SELECT 1)", "row_number() OVER ()", "foo(a)", "a; b", "nope", "lower(a, b)", "CAST(a AS nothing)", "a ="]
)
def test_refused(one, sql):
    with pytest.raises(AdmissionError):
        scalar(sql, one)


def test_cast_errors_and_filters(one):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one.select(scalar("CAST(s AS INT)", one)).collect()
    with pytest.raises(ContractError):
        filter_rows(one, "a + 1")
    assert filter_rows(one, "nb").count() == 0
    with pytest.raises(ContractError):
        project(one, [("x", "a"), ("X", "b")])
    with pytest.raises(ContractError):
        project(one, [])


def test_pass_through_keeps_metadata(one):
    df = one.select(F.col("a").alias("a", metadata={"source_name": "A", "unit": "m"}))
    out = project(df, [("a", "a"), ("b", "a"), ("c", "a + 1")]).schema
    assert out["a"].metadata == {"source_name": "A", "unit": "m"} and out["b"].metadata == {"unit": "m"} and out["c"].metadata == {}


def test_declarative(one):
    assert parse_comparison(" a >= -3 ") == ("a", ">=", -3)
    assert parse_comparison("s = 'it''s'")[2] == "it's" and parse_comparison("x != null")[2] is None
    for bad in ("a >", "1 = a", "a = nan", "a = 99999999999999999999", "a ~ 'x'"):
        with pytest.raises(AdmissionError):
            parse_comparison(bad)
    assert one.where(comparison("a > 6")).count() == 1
    assert one.where(declared({"call": "and", "args": [{"call": "gt", "args": [{"col": "a"}, 1]}, {"call": "is_null", "args": [{"col": "n"}]}]})).count() == 1
    with pytest.raises(AdmissionError):
        declared({"call": "between", "args": []})


def test_columns_of():
    assert columns_of(parse_scalar("a + lower(t.x) || CASE WHEN b THEN 1 END")) == {"a", "t", "b"}


def test_resource_file():
    r = parse_resource(
        """-- a file
        RESOURCE TARGET lake.t ROUTE BY f MAX TARGETS 3 DISPOSITION CDC_APPLY(k, j) DELETE SOFT(gone) CURSOR c TRUST FINANCIAL SEMANTICS (x => 'core.rate@1')
        EXECUTION DRAIN (CHECKPOINT ROWS 10, PACKAGE ELAPSED MILLISECONDS 5, UNTIL RECORDS 100, WATERMARK DISABLED, LATE DATA RECAPTURE NEXT EPOCH,
            SAFE FRONTIER CANONICAL ADMITTED SOURCE POSITION, TRANSACTION LIMIT BYTES 1000)
        AS SELECT k, j, c, f, x * 2 AS y FROM upstream(source => 'db', table => 't', o => OBJECT(a => ARRAY[1, -2, null])) WHERE k > 0;"""
    )
    assert (r.target, r.keys, r.delete.marker, r.trust, r.route.max_targets) == ("lake.t", ("k", "j"), "gone", "financial", 3)
    assert r.execution.until == ("records", 100) and r.execution.late == "recapture_next_epoch" and r.execution.transaction_limit_bytes == 1000
    assert r.arguments == {"table": "t", "o": {"a": [1, -2, None]}} and [n for n, _ in r.outputs] == ["k", "j", "c", "f", "y"]
    assert parse_resource("SELECT * FROM upstream(source => 's')").outputs is None


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a FROM t", "SELECT a FROM upstream(source => 's') JOIN upstream(source => 't')", "SELECT a FROM upstream(source => 's'), t", "SELECT a FROM upstream(source => 's') GROUP BY a",
        "SELECT a FROM upstream(source => 's') ORDER BY a", "SELECT a FROM upstream(source => 's') LIMIT 1", "SELECT DISTINCT a FROM upstream(source => 's')", "WITH q AS (SELECT 1) SELECT a FROM upstream(source => 's')",
        "SELECT a FROM upstream(source => 's') UNION SELECT 1", "SELECT sum(a) OVER () AS x FROM upstream(source => 's')", "SELECT a + 1 FROM upstream(source => 's')", "VALUES (1)",
        "RESOURCE TRUST GOVERNED TARGET x AS SELECT a FROM upstream(source => 's')", "RESOURCE DISPOSITION MERGE(a, a) AS SELECT a FROM upstream(source => 's')", "RESOURCE DISPOSITION MERGE AS SELECT a FROM upstream(source => 's')",
        "RESOURCE TRUST SOME AS SELECT a FROM upstream(source => 's')", "SELECT a FROM upstream(source => 's', k => 'secret://x')", "SELECT a FROM upstream(source => 's', k => 1 + a)", "SELECT a FROM upstream(table => 't')",
        "RESOURCE EXECUTION RESIDENT AS SELECT a FROM upstream(source => 's')", "RESOURCE DELETE HARD AS SELECT a FROM upstream(source => 's')", "SELECT a FROM upstream(source => 's') WHERE EXISTS (SELECT 1)",
    ],
)
def test_relational_sql_is_refused(sql):
    with pytest.raises(SluiceError):
        parse_resource(sql)


def test_filter_lints():
    from sluice.plans.lints import filter_lints

    assert filter_lints(["a > 5 AND a < 5"]) == ["no value of a passes"] and filter_lints(["a >= 5", "5 >= a"]) == []
    assert filter_lints(["a = 5 AND a < 5"]) == ["no value of a passes"] and filter_lints(["a > 1 OR a < 0"]) == []
    assert filter_lints(["id > 5", "id < 100"], "id", 10) == ["id > 5 is subsumed by the committed cursor"]
    assert filter_lints(["a = null"]) == ["a = null is never true"]


def test_gcd_of_any_size(spark):
    rng = random.Random(1)
    fib = [1, 1]
    while fib[-1] + fib[-2] < 2**63:
        fib.append(fib[-1] + fib[-2])
    pairs = [(fib[-1], fib[-2]), (0, 0), (0, 7), (7, 0), (-12, 18), (2**63 - 1, 2**62), (None, 3)] + [(rng.randrange(2**k), rng.randrange(2**k)) for k in range(1, 63)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = project(df, [("a", "a"), ("b", "b"), ("g", "gcd(a, b)")]).collect()
    assert all(r.g == (None if r.a is None else math.gcd(r.a, r.b)) for r in got)
