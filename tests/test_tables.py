"""Iceberg metadata, database targets, declared types, settlement of changes and the command line."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.__main__ import main
from sluice.errors import ContractError, DeliveryError, SchemaError
from sluice.plans.resource import Delete
from sluice.sinks.databases import Database, apply_statements, column_type, create_statement
from sluice.sources.iceberg import Table, read_iceberg
from sluice.streaming.changes import committed_transactions, event_prefix
from sluice.types import declared_schema, parse_type, redactions, semantic_rules, with_semantics


def _long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def _avro(kind, value) -> bytes:
    if isinstance(kind, list):
        return _long(kind.index("null")) if value is None else (lambda i: _long(i) + _avro(kind[i], value))(next(i for i, k in enumerate(kind) if k != "null"))
    name = kind["type"] if isinstance(kind, dict) else kind
    if name in ("int", "long"):
        return _long(value)
    if name == "string":
        return _long(len(value.encode())) + value.encode()
    if name == "array":
        return (_long(len(value)) + b"".join(_avro(kind["items"], v) for v in value) if value else b"") + _long(0)
    return b"".join(_avro(f["type"], value[f["name"]]) for f in kind["fields"])


def _container(path, kind, rows):
    body = b"".join(_avro(kind, r) for r in rows)
    meta = _long(1) + _avro("string", "avro.schema") + _avro("string", json.dumps(kind)) + _long(0)
    path.write_bytes(b"Obj\x01" + meta + b"m" * 16 + (_long(len(rows)) + _long(len(body)) + body + b"m" * 16 if rows else b""))


_MANIFEST = {
    "type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "sequence_number", "type": ["null", "long"]},
    {"name": "data_file", "type": {"type": "record", "name": "f", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "equality_ids", "type": ["null", {"type": "array", "items": "int"}]}]}}],
}
_LIST = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "sequence_number", "type": "long"}, {"name": "added_snapshot_id", "type": "long"}]}


def _table(spark, root, ids=True):
    """Four snapshots: rows 0-4, rows 5-9, position deletes of 1 and equality deletes of g = 1, rows 10-11."""
    (root / "metadata").mkdir()
    known = {"id": 1, "g": 2} if ids else {}

    def parquet(df, name):
        df = df.select(*[F.col(c).alias(c, metadata={"parquet.field.id": known[c]} if c in known else {}) for c in df.columns])
        df.coalesce(1).write.parquet(f"{root}/data/{name}")
        return "file://" + str(next((root / "data" / name).glob("*.parquet")))

    rows = lambda a, b: spark.range(a, b).select("id", (F.col("id") % 3).cast("int").alias("g"))
    one, two, four = parquet(rows(0, 5), "one"), parquet(rows(5, 10), "two"), parquet(rows(10, 12), "four")
    gone = parquet(spark.createDataFrame([(one, 1)], "file_path string, pos bigint"), "pos")
    same = parquet(spark.createDataFrame([(2,), (None,)], "g int"), "eq")
    steps = [[(1, 0, one, None)], [(1, 0, two, None)], [(1, 1, gone, None), (1, 2, same, [2])], [(1, 0, four, None)]]
    listed, snapshots = [], []
    for i, files in enumerate(steps, 1):
        _container(root / f"metadata/m{i}.avro", _MANIFEST, [{"status": s, "snapshot_id": None, "sequence_number": None, "data_file": {"content": c, "file_path": p, "file_format": "PARQUET", "equality_ids": ids}} for s, c, p, ids in files])
        listed.append({"manifest_path": f"file://{root}/metadata/m{i}.avro", "sequence_number": i, "added_snapshot_id": 100 + i})
        _container(root / f"metadata/snap{i}.avro", _LIST, listed)
        snapshots.append({"snapshot-id": 100 + i, "parent-snapshot-id": 99 + i if i > 1 else None, "timestamp-ms": 1000 * i, "manifest-list": f"file://{root}/metadata/snap{i}.avro", "summary": {"operation": "delete" if i == 3 else "append"}})
    meta = {
        "format-version": 2, "current-snapshot-id": 104, "snapshots": snapshots, "refs": {"old": {"snapshot-id": 101, "type": "tag"}}, "current-schema-id": 0,
        "schemas": [{"schema-id": 0, "type": "struct", "fields": [{"id": 1, "name": "id", "type": "long", "required": True}, {"id": 2, "name": "g", "type": "int", "required": False}, {"id": 3, "name": "new", "type": "string", "required": False}]}],
    }
    if not ids:
        meta["properties"] = {"schema.name-mapping.default": "[]"}
    (root / "metadata/v1.metadata.json").write_text(json.dumps(meta | {"current-snapshot-id": 101}))
    (root / "metadata/v2.metadata.json").write_text(json.dumps(meta))
    return f"file://{root}"


def test_iceberg_columns_by_id(spark, tmp_path):
    at = _table(spark, tmp_path)
    meta = json.loads((tmp_path / "metadata/v2.metadata.json").read_text())
    # g is called kind now, and a new column has taken its name
    fields = [{"id": 1, "name": "key", "type": "long"}, {"id": 2, "name": "kind", "type": "int"}, {"id": 4, "name": "g", "type": "string"}]
    (tmp_path / "metadata/v3.metadata.json").write_text(json.dumps(meta | {"schemas": [{"schema-id": 0, "type": "struct", "fields": fields}]}))
    found = sorted(map(tuple, read_iceberg(spark, at).collect()))
    assert found == [(i, i % 3, None) for i in (0, 3, 4, 6, 7, 9, 10, 11)]


@pytest.mark.parametrize("by_id", [True, False])
def test_iceberg(spark, tmp_path, by_id):
    at = _table(spark, tmp_path, by_id)
    ids = lambda **s: sorted(r["id"] for r in read_iceberg(spark, at, **s).collect())
    assert ids() == [0, 3, 4, 6, 7, 9, 10, 11]  # 1 by position; 2, 5 and 8 by equality; 11 came later
    assert ids(ref="old") == [0, 1, 2, 3, 4] and ids(as_of_ms=2500) == list(range(10)) and ids(snapshot_id=102, after=101) == [5, 6, 7, 8, 9]
    assert read_iceberg(spark, at).schema.names == ["id", "g", "new"] and Table.open(spark, at).select() == 104
    with pytest.raises(ContractError):
        ids(after=101)
    (tmp_path / "metadata/version-hint.text").write_text("1")
    assert ids() == [0, 1, 2, 3, 4]
    with pytest.raises(ContractError):
        read_iceberg(spark, f"file://{tmp_path}/data")


@pytest.mark.parametrize("dialect", ["duckdb", "sqlite"])
def test_database_targets(spark, tmp_path, dialect):
    db = Database(str(tmp_path / "t.db"), dialect)
    staging = f"file://{tmp_path}/stage" if dialect == "duckdb" else None
    one = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "k bigint, v string, d double")
    first = db.deliver("t", one, "p1", "append", staging=staging)
    assert db.deliver("t", one, "p1", "append", staging=staging) == first and db.query("SELECT * FROM t ORDER BY k") == [(1, "a", 1.5), (2, None, None)]
    assert db.deliver("t", one.limit(1), "p2", "replace", staging=staging).counts == {"kind": "rows", "rows_written": 1}
    db.deliver("m", one, "p1", "merge", ["k"], staging=staging)
    two = spark.createDataFrame([(2, "B", 2.0), (3, "c", 3.0)], "k bigint, v string, d double")
    assert db.deliver("m", two, "p2", "merge", ["k"], staging=staging).counts == {"kind": "keyed", "rows_written": 2, "inserted": 1, "updated": 1}
    assert db.query("SELECT k, v FROM m ORDER BY k") == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(DeliveryError):
        db.deliver("m", two.unionByName(two), "p3", "merge", ["k"], staging=staging)
    if dialect == "sqlite":
        with pytest.raises(SchemaError):
            db.deliver("x", spark.sql("SELECT map('a', 1) AS m"), "p", "append")


@pytest.mark.parametrize(("delete", "want"), [(Delete("hard"), [(2, "B"), (4, "d")]), (Delete("ignore"), [(1, "a"), (2, "B"), (4, "d")]), (Delete("soft", "gone"), [(1, "a", True), (2, "B", False), (4, "d", False)])])
def test_duckdb_changes(spark, tmp_path, delete, want):
    db = Database(str(tmp_path / "t.db"), "duckdb")
    start = spark.createDataFrame([(1, "a", "insert"), (2, "b", "insert")], "k int, v string, op string")
    changes = spark.createDataFrame([(1, None, "delete"), (2, "B", "update"), (3, None, "delete"), (4, "d", "insert")], "k int, v string, op string")
    db.deliver("t", start, "a", "cdc_apply", ["k"], delete)
    counts = db.deliver("t", changes, "b", "cdc_apply", ["k"], delete).counts
    assert db.query("SELECT * FROM t ORDER BY k") == want and (counts["inserted"], counts["updated"], counts["missing_delete"]) == (1, 1, 1)
    with pytest.raises(DeliveryError):
        Database(str(tmp_path / "s.db"), "sqlite").deliver("t", start, "a", "cdc_apply", ["k"], delete)


def test_a_failed_load_leaves_nothing(spark, tmp_path, monkeypatch):
    from sluice.sinks import databases

    db = Database(str(tmp_path / "t.db"), "sqlite")
    df = spark.createDataFrame([(1,)], "k int")
    with monkeypatch.context() as m:
        m.setattr(databases, "apply_statements", lambda *a, **b: ["INSERT INTO nowhere VALUES (1)"])
        with pytest.raises(Exception, match="nowhere"):
            db.deliver("t", df, "p", "append")
    assert db.query("SELECT count(*) FROM sqlite_master WHERE name = 't'") == [(0,)]
    db.deliver("t", df, "p", "append")
    assert db.query("SELECT * FROM t") == [(1,)]


def test_statements():
    schema = T.StructType.fromDDL("k bigint, v string, p decimal(10,2)")
    assert create_statement("s.t", schema, "postgres", ["k"]) == 'CREATE TABLE IF NOT EXISTS "s"."t" ("k" BIGINT, "v" TEXT, "p" DECIMAL(10,2), PRIMARY KEY ("k"))'
    assert "ENGINE = MergeTree ORDER BY (`k`)" in create_statement("t", schema, "clickhouse", ["k"])
    assert apply_statements("t", "s", ["k", "v"], "merge", "postgres", ["k"]) == ['INSERT INTO "t" ("k", "v") SELECT "k", "v" FROM "s" ON CONFLICT ("k") DO UPDATE SET "v" = excluded."v"']
    assert "LEFT ANTI JOIN" in apply_statements("t", "s", ["k", "v"], "merge", "clickhouse", ["k"])[0]
    with pytest.raises(DeliveryError):
        apply_statements("t", "s", ["k"], "cdc_apply", "clickhouse", ["k"])
    assert column_type(T.ArrayType(T.LongType()), "duckdb") == "BIGINT[]"


def test_declared_types():
    assert parse_type("timestamp(us, UTC)") == (T.TimestampType(), {"timezone": "UTC"}) and parse_type("timestamp(ms)")[0] == T.TimestampNTZType()
    assert parse_type("struct<a: list<int32>, b: map<utf8, decimal128(10, 2)>>")[0].simpleString() == "struct<a:array<int>,b:map<string,decimal(10,2)>>"
    assert parse_type("uint64")[0] == T.DecimalType(20, 0) and parse_type("timestamp(ns)")[0] == T.LongType() and parse_type("decimal256(50, 2)")[0] == T.StringType()
    for bad in ("int128", "decimal128(40, 2)", "struct<a>", "list<int32", "timestamp(weeks)", "time32(us)", "struct<a: int8, a: int8>"):
        with pytest.raises(SchemaError):
            parse_type(bad)
    schema = with_semantics(declared_schema({"mail": "utf8", "n": "uint8"}, ("n",)), {"mail": "core.email@1"})
    assert schema["n"].nullable is False and schema["n"].metadata["max"] == "255" and redactions(schema) == {"mail": "hash"} and len(semantic_rules(schema)) == 1
    for bad in ({"mail": "core.nothing@1"}, {"x": "core.email@1"}, {"n": "core.email@1"}):
        with pytest.raises(SchemaError):
            with_semantics(schema, bad)


def test_settlement(spark):
    log = spark.createDataFrame([(1, "a", "begin"), (2, "a", None), (3, "b", "begin"), (4, "b", None), (5, "a", "terminal"), (6, "b", None)], "p int, t string, marker string")
    settled, held = committed_transactions(log, "t")
    assert [r["p"] for r in settled.collect()] == [2] and sorted(r["p"] for r in held.collect()) == [4, 6]
    settled, held, last = event_prefix(log, "p")
    assert sorted(r["p"] for r in settled.collect()) == [2, 4] and [r["p"] for r in held.collect()] == [6] and last == 5
    assert event_prefix(log.where("marker is null"), "p")[2] is None


def test_command_line(spark, tmp_path, capsys):
    def said(*argv, code=0):
        assert main([*argv, "--project", str(tmp_path)]) == code
        out = capsys.readouterr().out
        return json.loads(out) if out.startswith(("{", "[")) else out

    said("init")
    spark.createDataFrame([(i, "a" if i % 4 else "bad") for i in range(12)], "id bigint, v string").write.parquet(f"{tmp_path}/in/t.parquet")
    (tmp_path / "sluice.json").write_text(json.dumps({"sources": {"mem": {"root": f"{tmp_path}/in"}}, "max_age_ms": {"one": 10**9}}))
    said("add", "one", "RESOURCE DISPOSITION APPEND CURSOR id TRUST GOVERNED AS SELECT id, v FROM upstream(source => 'mem', table => 't') WHERE id >= 2")
    assert said("add", "two", "SELECT a FROM b", code=1) == ""
    (tmp_path / "contracts/one.json").write_text(json.dumps({"rules": [{"kind": "domain", "rule_id": "known", "column": "v", "allowed": ["a"]}]}))
    assert said("validate")["one"]["columns"] == ["id", "v"] and len(said("preview", "one", "--limit", "3")) == 2 and said("contract", "one")["rules"][0]["kind"] == "domain"
    assert "Scan parquet" in said("explain", "one", "--filter", "id < 5") and said("plan", "one")["guarantee"] == "at_least_once"
    first = said("run", "one")
    assert (first["rows"], first["quarantined"], first["checkpoint"]) == (8, 2, 1)
    assert said("sql", "SELECT count(*) AS n FROM packages")[0]["n"] == 1 and said("status")["summary"]["fresh"] == 1 and said("doctor") == [{"target": "one", "state": "match"}]
    assert said("package", first["package"], "verify")["row_count"] == 8 and len(said("state", "one")) == 1 and said("schema", "one")["fields"][0]["name"] == "id"
    assert [w["rows"] for w in said("backfill", "one", "2", "12", "5")] == [4, 4] and said("discover", "mem", "t")["fields"][1]["name"] == "v"


@pytest.mark.parametrize("disposition, keys, delete, want", [
    ("append", (), Delete(), [(1, "a"), (2, "b"), (2, "B"), (3, "C")]),
    ("replace", (), Delete(), [(2, "B"), (3, "C")]),
    ("merge", ("k",), Delete(), [(1, "a"), (2, "B"), (3, "C")]),
    ("cdc_apply", ("k",), Delete("ignore"), [(1, "a"), (2, "b"), (3, "C")]),
    ("cdc_apply", ("k",), Delete("hard"), [(1, "a"), (3, "C")]),
])
def test_postgres_statements_run(disposition, keys, delete, want):
    """The statements for a server, run by an engine that takes them as they are."""
    import duckdb

    shape = T.StructType.fromDDL("k int, v string")
    db = duckdb.connect()
    db.execute(create_statement("t", shape, "postgres", keys))
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    changes = disposition == "cdc_apply"
    db.execute("CREATE TABLE stage AS SELECT * FROM (VALUES (2, 'B', 'delete'), (3, 'C', 'insert')) v(k, v, op)")
    if not changes:
        db.execute("ALTER TABLE stage DROP COLUMN op")
    for sql in apply_statements("t", "stage", ["k", "v", "op"] if changes else ["k", "v"], disposition, "postgres", keys, delete, "op"):
        db.execute(sql)
    assert sorted(db.execute("SELECT k, v FROM t").fetchall()) == sorted(want)
