"""Contracts, schemas, residuals, statistics, late data and routes on small frames, null and odd cases included."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ContractError, DeliveryError, SchemaError
from sluice.operators import contract as C
from sluice.operators import late, residual, routing, schema, segments, statistics, transforms
from sluice.operators.dedup import dedup_summary, distinct_rows, keep_one, refuse_repeats, split_changes


def ddl(text):
    return T.StructType.fromDDL(text)


def broken(df, rule):
    return [r["v"] for r in C.with_violations(df, C.Contract((rule,))).select((F.size("violations") > 0).alias("v")).collect()]


def test_rules_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (None, None, None), (9, "b", -0.0)], "i int, s string, d double").coalesce(1)
    assert broken(df, C.Nullability("r", "i")) == [False, True, False]
    assert broken(df, C.Domain("r", "s", ("a",))) == [False, False, True]
    assert broken(df, C.Domain("r", "i", ("1", "09"))) == [False, False, True]
    assert broken(df, C.Domain("r", "d", ("0.0",))) == [False, False, True]
    assert broken(df, C.Range("r", "i", "1", "8")) == [False, False, True]
    assert broken(df, C.Range("r", "i")) == [False, False, False]
    assert broken(df, C.Regex("r", "s", "^a")) == [False, False, True]
    with pytest.raises(ContractError):
        broken(df, C.Range("r", "s", "1"))
    with pytest.raises(ContractError):
        broken(df, C.Range("r", "i", "1.5"))
    with pytest.raises(ContractError):
        broken(df, C.Nullability("r", "missing"))


def test_nan_has_no_range_but_may_be_listed(spark):
    df = spark.createDataFrame([(math.nan,)], "d double")
    with pytest.raises(Exception, match="NaN"):
        broken(df, C.Range("r", "d", "0"))
    assert broken(df, C.Range("r", "d")) == [False]
    assert broken(df, C.Domain("r", "d", ("NaN",))) == [False] and broken(df, C.Domain("r", "d", ("1.0",))) == [True]


def test_freshness_is_strict_and_null_violates(spark):
    df = spark.sql("SELECT timestamp_ntz'1970-01-01 00:00:01.0009' AS t UNION ALL SELECT timestamp_ntz'1970-01-01 00:00:00.9999' UNION ALL SELECT NULL").coalesce(1)
    assert broken(df, C.Freshness("r", "t", 1000, 2000)) == [False, True, True]


def test_validate_evidence_and_trust(spark):
    df = spark.createDataFrame([(1, "x"), (20, "y"), (None, "z")], "i int, s string")
    c = C.Contract((C.Range("range", "i", "0", "9"), C.Nullability("there", "i")), redact={"i": "hash"})
    v = C.validate(df, c, ["s"])
    assert [r["i"] for r in v.accepted.collect()] == [1]
    assert sorted((r["s"], r["rule_id"], r["error_code"], (r["value"] or "")[:7]) for r in v.quarantine.collect()) == [("y", "range", "range_violation", "sha256:"), ("z", "there", "nullability_violation", "")]
    assert v.summary().first().asDict() == {"input_rows": 3, "accepted_rows": 1, "quarantined_rows": 2}
    v.enforce()
    with pytest.raises(ContractError):
        C.validate(df, C.Contract(c.rules, trust=C.TRUST["financial"])).enforce()
    assert C.validate(df.limit(0), c).summary().first().asDict() == {"input_rows": 0, "accepted_rows": 0, "quarantined_rows": 0}
    assert C.Contract((C.Range("r", "i", "5", "1"), C.Range("q", "i"))).lints() == ["r: unsatisfiable", "q: always true"]
    with pytest.raises(ContractError):
        C.check_total({C.Outcome.PASS: C.Verdict.ACCEPT})
    assert [C.validation_depth(C.TRUST["serving"], n) for n in (0, 3)] == ["full", "sampled_fast_path"]
    assert C.validation_depth(C.TRUST["serving"], 9, quarantined=1) == "full" and C.validation_depth(C.TRUST["governed"], 9) == "full"


def test_dedup(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 3, "c"), (None, 4, "d")], "k int, o int, v string")
    assert sorted(r["v"] for r in keep_one(df, ["k"], ["o"]).collect()) == ["a", "c"]
    assert sorted(r["v"] for r in keep_one(df, ["k"], ["o"], "last").collect()) == ["b", "d"]
    for n in (1, 4, 16):
        assert sorted(r["v"] for r in keep_one(df.repartition(n), ["k"], ["o"]).collect()) == ["a", "c"]
    with pytest.raises(ContractError):
        refuse_repeats(df, ["k"])
    with pytest.raises(ContractError):
        keep_one(df, ["k"], [])
    assert dedup_summary(df, ["k"]).first().asDict() == {"input_rows": 4, "duplicate_key_count": 2, "dropped_row_count": 2}
    maps = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert distinct_rows(maps).count() == 1
    with pytest.raises(Exception, match="unknown operation"):
        split_changes(spark.createDataFrame([("upsert",)], "op string"))[0].collect()


def test_keep_one_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 2)
    plan = keep_one(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_reconcile_and_conform(spark):
    kinds = {d.name: d.decision for d in schema.reconcile(ddl("a int, b int, c string, d double, e string, g date"), ddl("a int, b bigint, c int, d float, f int, g timestamp"))}
    assert kinds == {"a": "preserved", "b": "widened", "c": "coerced", "d": "lossy_rejected", "f": "missing", "g": "widened", "e": "extra"}
    assert schema.reconcile_type(T.IntegerType(), T.DecimalType(12, 2))[0] == "widened" and schema.reconcile_type(T.IntegerType(), T.DecimalType(11, 2))[0] == "lossy_rejected"
    assert schema.reconcile_type(T.StringType(), T.IntegerType(), schema.TypePolicy(coerce_types=False)) == ("lossy_rejected", "coerce_types")
    assert schema.reconcile_type(T.BooleanType(), T.DateType())[0] == "unsupported"
    df = spark.createDataFrame([("1",), ("x",), (None,)], "c string")
    out, _ = schema.conform(df, ddl("c int, more string"))
    assert [tuple(r) for r in out.collect()] == [(1, None), (None, None), (None, None)]
    with pytest.raises(SchemaError):
        schema.conform(df, ddl("c array<int>"))


def test_schema_join_over_files(spark):
    joined, verdicts = schema.join_schemas({"b": ddl("x bigint, z string"), "a": ddl("x int, y float")})
    assert joined.simpleString() == "struct<x:bigint,y:float,z:string>"
    assert [(v["location"], v["field"], v["verdict"]) for v in verdicts] == [("a", "x", "widened"), ("a", "y", "preserved"), ("a", "z", "missing_null"), ("b", "x", "preserved"), ("b", "y", "missing_null"), ("b", "z", "preserved")]
    with pytest.raises(SchemaError):
        schema.union_files({"a": spark.createDataFrame([("q",)], "x string"), "b": spark.createDataFrame([(True,)], "x boolean")})
    with pytest.raises(SchemaError):
        schema.join_schemas({})


def test_json_type_merge():
    merge, long, text = schema.merge_json_types, T.LongType(), T.StringType()
    assert merge(T.NullType(), long) == long and merge(long, T.DoubleType()) == T.DoubleType() and merge(long, text) == text
    assert merge(T.ArrayType(long), long) == T.ArrayType(long) and merge(T.BooleanType(), long) == text
    with pytest.raises(SchemaError):
        merge(ddl("a int"), long)


@pytest.mark.parametrize(
    ("name", "want"),
    [("OrderID", "order_id"), ("HTTPServer", "http_server"), ("already_snake", "already_snake"), ("  a--b ", "a_b"), ("Éa", "a"), ("日本", "field"), ("", "field"), ("a1B2", "a1_b2"), ("x9Y", "x9_y"), ("ABC", "abc")],
)
def test_names(name, want):
    assert schema.normalize_name(name) == want


def test_long_names_and_clashes(spark):
    long = schema.normalize_name("A" * 40, schema.NamePolicy(20))
    assert len(long) == 20 and long != schema.normalize_name("A" * 41, schema.NamePolicy(20))
    with pytest.raises(ContractError):
        schema.normalize_name("x", schema.NamePolicy(9))
    with pytest.raises(ContractError):
        schema.normalize_name("1x", schema.NamePolicy(None, "^[a-z]"))
    with pytest.raises(ContractError):
        schema.normalize_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))
    assert schema.normalize_columns(spark.createDataFrame([(1,)], "`OrderID` int")).schema["order_id"].metadata == {"source_name": "OrderID"}


def test_residual_envelope(spark):
    df = spark.createDataFrame([(1, 'q"t', 5, "x"), (2, None, None, "7")], "k int, `a/b` string, n bigint, t string")
    out = residual.capture(df, ["k", "t"], unfit={"t": T.IntegerType()}).orderBy("k")
    first, second = out.collect()
    got = json.loads(first["_variant"])
    assert got == {"v": 1, "fields": {"/a~1b": {"arrow_type": "string", "encoding": "text", "value": 'q"t'}, "/n": {"arrow_type": "bigint", "encoding": "decimal_text", "value": "5"}, "/t": {"arrow_type": "string", "encoding": "text", "value": "x"}}}
    assert list(got["fields"]) == sorted(got["fields"]) and second["_variant"] is None and (first["t"], second["t"]) == (None, 7)
    up = residual.promote(out, "/n", "n", "bigint").orderBy("k").collect()
    assert up[0]["n"] == 5 and "/n" not in json.loads(up[0]["_variant"])["fields"] and up[1]["n"] is None
    assert {(r["path"], r["rows"]) for r in residual.promotion_candidates(out).collect()} == {("/a~1b", 1), ("/n", 1), ("/t", 1)}
    with pytest.raises(ContractError):
        residual.capture(out, ["k"])


def test_statistics_completeness_and_pruning(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, None, math.nan), (1, 5, 2.0), (2, None, None)], "s int, i int, d double")
    rows = {(r["s"], r["column"]): r for r in statistics.segment_and_package(df, "s").collect()}
    assert (rows[0, "i"]["minimum"], rows[0, "i"]["null_count"], rows[0, "d"]["complete"], rows[0, "d"]["maximum"]) == ("1", 1, False, None)
    assert rows[None, "d"]["complete"] is False and rows[None, "d"]["row_count"] == 4 and (rows[None, "i"]["minimum"], rows[None, "i"]["maximum"]) == ("1", "5")
    kinds = {"i": "int", "d": "double"}
    merged = {r["column"]: r for r in statistics.merge_profiles(statistics.profile(df, ["s"]), kinds).collect()}
    assert merged["d"]["complete"] is False and merged["d"]["minimum"] is None and (merged["i"]["minimum"], merged["i"]["maximum"], merged["i"]["row_count"]) == ("1", "5", 4)
    plan = statistics.profile(df.withColumn("t", F.lit("x")), ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "Sort " not in plan
    prof = statistics.profile(df, ["s"])

    def outcome(predicate):
        return [r["outcome"][:10] for r in statistics.prune(prof, "s", predicate, kinds).orderBy("s").collect()]

    assert outcome("i > 3") == ["pruned", "retained_m", "pruned"]
    assert outcome("NOT (i > 3)") == ["retained_m", "pruned", "pruned"]
    assert outcome("d > 100") == ["retained_c", "pruned", "pruned"]
    assert outcome("i IS NULL") == ["retained_m", "pruned", "retained_m"]
    assert outcome("3 < i OR d = 2.0") == ["retained_c", "retained_m", "pruned"]
    for predicate in ("i > 3", "i <= 1", "NOT i = 5", "i IS NULL OR i = 5"):
        kept = {r["s"] for r in statistics.prune(prof, "s", predicate, kinds).collect() if r["outcome"] != "pruned"}
        assert {r["s"] for r in df.where(predicate).collect()} <= kept


def test_late_rows_go_one_way_each(spark):
    df = spark.createDataFrame([("a", 5), ("a", 9), ("b", 7), ("b", None)], "p string, t bigint")
    claims = late.partition_watermarks(df, "p", "t")
    assert late.global_watermark(claims).first()[0] == 7
    waiting = claims.unionByName(spark.createDataFrame([("c", None)], "p string, watermark bigint"))
    assert late.global_watermark(waiting, 3).first()[0] == 3 and late.global_watermark(waiting).first()[0] is None
    assert late.global_watermark(waiting, 3, idle=("c",)).first()[0] == 7 and late.global_watermark(claims, 8).first()[0] == 8
    for action, sizes in (("quarantine", (3, 1, 0)), ("recapture_next_epoch", (3, 0, 1)), ("admit_with_annotation", (4, 0, 0))):
        s = late.split_late(df, "t", 7, action)
        assert (s.admitted.count(), s.quarantined.count(), s.carried.count()) == sizes
    assert late.split_late(df, "t", None).admitted.count() == 4
    with pytest.raises(ContractError):
        late.split_late(df, "p", "a")
    with pytest.raises(Exception, match="went back"):
        late.advance(claims, claims.withColumn("watermark", F.col("watermark") - 1)).collect()


def test_routes(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "r string")
    assert {(r["route"], r["rows"]) for r in routing.route_counts(df, "r", 2).collect()} == {("string:x", 2), ("string:y", 1)}
    assert routing.with_route(spark.createDataFrame([(1,)], "r bigint"), "r").first()["_route"] == "long:1"
    with pytest.raises(DeliveryError):
        routing.route_counts(df, "r", 1)
    with pytest.raises(Exception, match="null has no route"):
        routing.with_route(spark.createDataFrame([(None,)], "r string"), "r").collect()
    with pytest.raises(DeliveryError):
        routing.check_routes(df, "r", ["x"])


def test_ordinals_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("o"), "id")
    want = None
    for n in (1, 4, 16):
        got = [(r["_ordinal"], r["id"]) for r in segments.with_ordinal(df.repartition(n), ["o"]).orderBy("_ordinal").collect()]
        assert [g[0] for g in got] == list(range(1000))
        want = want or got
        assert got == want
    sizes = spark.createDataFrame([(0, 60), (1, 60), (2, 10), (3, 100)], "batch int, bytes bigint")
    assert [r["segment"] for r in segments.segments_by_bytes(sizes, 100).orderBy("batch").collect()] == [0, 0, 1, 1]
    assert segments.limit_in_order(df, ["o"], 0).count() == 0
    assert segments.stratified(df.withColumn("s", F.col("id") % 3), "s", "id", 2).count() == 6


def test_transforms_see_earlier_ones(spark):
    df = spark.createDataFrame([(1, "5", [1, 2]), (2, "x", None)], "a int, t string, l array<int>")
    out = transforms.apply_transforms(df, [transforms.Derive("b", "a * 2"), transforms.Filter("b > 2"), transforms.Rename("b", "c"), transforms.Derive("d", "c + 1")])
    assert [(r["c"], r["d"]) for r in out.collect()] == [(4, 5)]
    assert transforms.apply_transforms(df, [transforms.ExpandNested("l", "child")]).count() == 3
    assert transforms.apply_transforms(df, [transforms.ExpandNested("l", "variant")]).first()["l"] == "[1,2]"
    with pytest.raises(ContractError):
        transforms.apply_transforms(df, [transforms.Cast("a", "smallint")])
    with pytest.raises(ContractError):
        transforms.apply_transforms(df, [transforms.Rename("a", "t")])
