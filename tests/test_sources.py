"""Readers of files, databases, HTTP pages, programs and table formats."""

import bz2
import gzip
import json
import lzma
import sqlite3
import struct
import sys
import zlib

import duckdb
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ContractError, SchemaError
from sluice.plans.resource import SOURCES, delivery_guarantee, pushdown, pushes_limit
from sluice.sources import databases, files, programs, rest, tables


def ddl(text):
    return T.StructType.fromDDL(text)


def test_resolve_and_manifest(spark, tmp_path):
    for name in ("a.csv", "b.csv", "c.txt"):
        (tmp_path / name).write_text("x\n1\n")
    found = files.resolve(spark, f"file://{tmp_path}", "*.csv")
    assert [p.rsplit("/", 1)[1] for p, *_ in found] == ["a.csv", "b.csv"]
    for bad in ("../x", "/etc/*", "s3://b/*"):
        with pytest.raises(ContractError):
            files.resolve(spark, f"file://{tmp_path}", bad)
    now = files.manifest(found)
    assert files.pick_files("append", now, now[:1]) == [now[1][0]] and len(files.pick_files("replace", now, now)) == 2


def test_templates():
    assert files.expand_template("h/{08..10}.gz") == ["h/08.gz", "h/09.gz", "h/10.gz"]
    assert files.expand_template("{2023-11..2024-02}/{1..2}")[:3] == ["2023-11/1", "2023-11/2", "2023-12/1"] and len(files.expand_template("{2023-11..2024-02}/{1..2}")) == 8
    for bad in ("{a..b}", "{5..1}", "{1..99999}"):
        with pytest.raises(ContractError):
            files.expand_template(bad)


def test_delimited(spark, tmp_path):
    (tmp_path / "a.psv").write_text("id|name\n#note\n1|'x|y'\n2|\n")
    df = files.read_delimited(spark, [str(tmp_path / "a.psv")], delimiter="|", quote="'", comment="#")
    assert [tuple(r) for r in df.collect()] == [("1", "x|y"), ("2", None)]
    (tmp_path / "b.csv").write_bytes("k,v\n1,ä\n".encode("windows-1252"))
    assert files.read_delimited(spark, [str(tmp_path / "b.csv")], encoding="windows-1252").first()["v"] == "ä"
    (tmp_path / "c.csv").write_text("k,v\n1\n")
    assert files.read_delimited(spark, [str(tmp_path / "c.csv")], "k string, v string", truncated_rows=True).first()["v"] is None
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_delimited(spark, [str(tmp_path / "c.csv")], "k string, v string").collect()
    with pytest.raises(ContractError):
        files.read_delimited(spark, ["x.csv.xz"])


def test_fixed_width(spark, tmp_path):
    (tmp_path / "f.txt").write_text("001ä  9\n002N/A\n")
    df = files.read_fixed_width(spark, [str(tmp_path / "f.txt")], [("k", 0, 3), ("v", 3, 3), ("n", 6, 1)], null_tokens=("N/A",))
    assert [tuple(r) for r in df.collect()] == [("001", "ä", "9"), ("002", None, None)]


def test_json(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"a": 1, "b": [1]}\nbroken\n{"a": 2.5, "b": 2, "c": {"d": null}}\n')
    good, bad = files.read_ndjson(spark, [str(tmp_path / "a.ndjson")], ddl("a double"))
    assert sorted(r["a"] for r in good.collect()) == [1.0, 2.5] and [r[0] for r in bad.collect()] == ["broken"]
    found = files.discover_json(spark, [str(tmp_path / "a.ndjson")])
    assert found["a"].dataType == T.DoubleType() and found["b"].dataType == T.ArrayType(T.LongType()) and found["c"].dataType == T.StructType([T.StructField("d", T.NullType())])
    (tmp_path / "d.json").write_text(json.dumps({"rows": [{"x": 1}, {"x": 2}]}))
    assert [r["x"] for r in files.read_json_document(spark, [str(tmp_path / "d.json")], ddl("x int"), "$.rows").collect()] == [1, 2]
    with pytest.raises(ContractError):
        files.read_json_document(spark, ["x"], ddl("x int"), "$..rows")


def _framed(data: bytes) -> bytes:
    chunk = lambda kind, body: bytes([kind]) + len(body).to_bytes(3, "little") + body
    raw = bytes([len(data) & 0x7F]) if len(data) < 128 else bytes([len(data) & 0x7F | 0x80, len(data) >> 7])
    block = pa.Codec("snappy").compress(data, asbytes=True)
    assert block.startswith(raw)
    return chunk(0xFF, b"sNaPpY") + chunk(0, b"\0\0\0\0" + block) + chunk(1, b"\0\0\0\0" + b"tail\n")


def test_compressed_lines(spark, tmp_path):
    text = "one\ntwo ü\n".encode()
    made = {
        "a.gz": gzip.compress(text), "b.bz2": bz2.compress(text), "c.xz": lzma.compress(text), "d.zst": zstandard.compress(text), "e.lz4": pa.Codec("lz4").compress(text, asbytes=True),
        "f.br": pa.Codec("brotli").compress(text, asbytes=True), "g.sz": _framed(text), "h.txt": text,
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = files.read_decoded_lines(spark, [str(tmp_path)])
    by_file = {r["f"]: sorted(r["v"]) for r in got.groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).agg(F.collect_list("value").alias("v")).collect()}
    assert set(by_file) == set(made) and all(v == (["one", "tail", "two ü"] if k == "g.sz" else ["one", "two ü"]) for k, v in by_file.items())


def test_arrow_ipc(spark, tmp_path):
    table = pa.table({"a": pa.array([1, 2], pa.int32()), "b": ["x", None]})
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as out, pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    with pa.OSFile(str(tmp_path / "s.arrows"), "wb") as out, pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    df = files.read_arrow_ipc(spark, [str(tmp_path)], ddl("b string, a bigint"))
    assert sorted((r["a"], r["b"] or "") for r in df.collect()) == [(1, "x"), (1, "x"), (2, ""), (2, "")]


def _zz(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy", "zstandard"])
def test_avro(spark, tmp_path, codec):
    shape = {"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "l", "type": {"type": "array", "items": "double"}}, {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["A", "B"]}}]}
    text = lambda s: _zz(len(s.encode())) + s.encode()
    block = _zz(-5) + _zz(1) + text("hé") + _zz(2) + struct.pack("<dd", 1.5, -2) + _zz(0) + _zz(1) + _zz(300) + _zz(0) + _zz(0) + _zz(0)
    packed = {"null": lambda: block, "deflate": lambda: zlib.compress(block)[2:-4], "snappy": lambda: pa.Codec("snappy").compress(block, asbytes=True) + b"\0\0\0\0", "zstandard": lambda: zstandard.compress(block)}[codec]()
    meta = _zz(2) + text("avro.schema") + text(json.dumps(shape)) + text("avro.codec") + text(codec) + _zz(0)
    (tmp_path / "a.avro").write_bytes(b"Obj\x01" + meta + b"s" * 16 + _zz(2) + _zz(len(packed)) + packed + b"s" * 16)
    df = files.read_avro(spark, [str(tmp_path / "a.avro")], ddl("id bigint, s string, l array<double>, e string"))
    assert [tuple(r) for r in df.collect()] == [(-5, "hé", [1.5, -2.0], "B"), (300, None, [], "A")]
    with pytest.raises(SchemaError):
        list(files.avro_records(b"nope"))


def test_protobuf(spark, tmp_path):
    def varint(n):
        n &= (1 << 64) - 1
        out = b""
        while True:
            out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
            n >>= 7
            if not n:
                return out

    field = lambda number, wire, body: varint(number << 3 | wire) + body
    chunk = lambda b: varint(len(b)) + b
    one = field(1, 0, varint(-3)) + field(2, 2, chunk("né".encode())) + field(3, 2, chunk(varint(1) + varint(300))) + field(4, 1, struct.pack("<d", 2.5)) + field(5, 2, chunk(field(1, 0, varint(1)))) + field(9, 0, varint(7))
    two = field(3, 0, varint(5)) + field(6, 0, varint(3))
    (tmp_path / "m.pb").write_bytes(chunk(one) + chunk(two))
    fields = {1: ("id", "int64"), 2: ("s", "string"), 3: ("r", "repeated:uint32"), 4: ("d", "double"), 5: ("n", "message", {1: ("ok", "bool")}), 6: ("z", "sint32")}
    df = files.read_protobuf(spark, [str(tmp_path / "m.pb")], fields, ddl("id bigint, s string, r array<bigint>, d double, n struct<ok:boolean>, z int"))
    a, b = df.collect()
    assert (a["id"], a["s"], a["r"], a["d"], a["n"]["ok"], a["z"]) == (-3, "né", [1, 300], 2.5, True, None) and (b["id"], b["r"], b["z"]) == (None, [5], -2)
    with pytest.raises(SchemaError):
        files.protobuf_message(field(2, 2, varint(9) + b"x"), fields)


def test_database_queries():
    scan = databases.Scan("s.t", ("a", "b"), ("a >= 3", "b != 'x''y'"), ("a",), 5)
    assert databases.build_query(scan, "postgres") == ('SELECT "a", "b" FROM "s"."t" WHERE "a" >= 3 ORDER BY "a"', ["b != 'x''y'"])
    assert databases.build_query(databases.Scan("t", (), ("b = 'x''y'",), (), 5), "mysql") == ("SELECT * FROM `t` WHERE `b` = 'x''y' LIMIT 5", [])
    assert databases.build_query(databases.Scan("t", ("a",), ("a > 1",), (), 5), "sqlite") == ('SELECT "a" FROM "t" WHERE "a" > 1', ["a > 1"])
    assert databases.build_query(databases.Scan("t", ("a",), (), (), 5, "a", 7), "clickhouse") == ("SELECT `a` FROM `t` WHERE `a` > 7", [])
    assert databases.quoted('a"b', "postgres") == '"a""b"' and databases.literal("a\\'b", "mysql") == "'a\\\\''b'"
    assert pushdown(SOURCES["sqlite"], "=") == "inexact" and pushdown(SOURCES["postgres"], "!=") == "unsupported" and not pushes_limit(SOURCES["postgres"], ["!="], False)
    assert delivery_guarantee("merge", True) == "per_key"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, score REAL, raw BLOB)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, f"n{i}" if i % 2 else None, i / 2, b"x") for i in range(50)])
    df = databases.read_sqlite(spark, path, "t", partitions=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 50 and df.schema["id"].dataType == T.LongType()
    got = databases.read_sqlite(spark, path, "t", partitions=3, filters=("id >= 10", "score < 10")).where("name IS NOT NULL")
    assert sorted(r["id"] for r in got.collect()) == [11, 13, 15, 17, 19]
    assert databases.read_sqlite(spark, path, query="SELECT name, count(*) AS n FROM t GROUP BY 1").where("name = 'n1'").first()["n"] == "1"
    assert databases.resume_after(df, "id", 47).count() == 2 and databases.resume_after(df, "id", None).count() == 50


def test_pagination_kinds():
    made = {"items": [{"id": i} for i in range(7)]}

    def serve(url, headers):
        import urllib.parse as u

        q = dict(u.parse_qsl(u.urlsplit(url).query))
        start = int(q.get("offset", 0)) if "offset" in q else (int(q.get("page", 1)) - 1) * 3 if "page" in q else int(q.get("cursor", q.get("page_token", 0)))
        body = {"items": made["items"][start : start + 3]}
        more = start + 3 < 7
        head = {}
        if "link" in url and more:
            head["Link"] = f'<https://h/link?cursor={start + 3}>; rel="next"'
        elif more:
            body["next_cursor"] = str(start + 3)
            body["next_page_token"] = str(start + 3)
        return json.dumps(body).encode(), head

    for kind, url in (("page", "https://h/a"), ("offset", "https://h/a"), ("cursor", "https://h/a"), ("link", "https://h/link"), ("auto", "https://h/a"), ("auto", "https://h/link")):
        e = rest.Endpoint(url, "items", rest.Pagination(kind, size=3), allowed_hosts=("h",))
        assert [r["id"] for r in rest.records(e, serve)] == list(range(7)), kind
    e = rest.Endpoint("https://h/a", "items", rest.Pagination("page"), cursor_param="since", cursor_field="id", cursor_after=4, allowed_hosts=("h",))
    assert [r["id"] for r in rest.records(e, serve)] == [5, 6]
    with pytest.raises(ContractError):
        list(rest.records(rest.Endpoint("https://other/a", allowed_hosts=("h",)), serve))
    with pytest.raises(ContractError):
        list(rest.records(rest.Endpoint("https://h/a", "items", rest.Pagination("link"), allowed_hosts=("h",)), lambda u, h: (b'{"items": []}', {"Link": "<https://h/a>; rel=next"})))


def test_retries(monkeypatch):
    monkeypatch.setattr(rest.time, "sleep", lambda s: None)
    calls = []

    def flaky(url, headers):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("reset")
        return b'[{"a": 1}]', {}

    e = rest.Endpoint("https://h/a", "$", rest.Pagination("none"), allowed_hosts=("*.x", "h"))
    assert list(rest.records(e, flaky)) == [{"a": 1}] and len(calls) == 3
    with pytest.raises(OSError):
        list(rest.records(e, lambda u, h: (_ for _ in ()).throw(OSError("down"))))
    assert rest.wait_seconds({"Retry-After": "7"}, 0, 0) == 7 and rest.wait_seconds({"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "12"}, 0, 10) == 2


def test_programs(spark, tmp_path):
    @programs.resource("a int, p string", partitions=("x", "y"))
    def made(part):
        yield {"a": 1, "p": part}
        yield pa.table({"p": [part], "a": pa.array([2], pa.int32())})

    assert sorted(tuple(r) for r in programs.read_python(spark, made).collect()) == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
    assert programs.from_dlt({"name": "n", "primary_key": "id", "write_disposition": "merge"}, lambda: [], "a int").primary_key == ("id",)
    with pytest.raises(ContractError):
        programs.from_dlt({"write_disposition": "skip"}, lambda: [], "a int")
    script = tmp_path / "tap.py"
    script.write_text(
        """print('{"type":"SCHEMA","stream":"s"}\\n{"type":"RECORD","stream":"s","record":{"a":1}}\\n{"type":"RECORD","stream":"t","record":{"a":9}}\\n{"type":"STATE","value":{"at":1}}')
print('{"type":"RECORD","record":{"stream":"s","data":{"a":4},"emitted_at":1}}')"""
    )
    lines = programs.run_lines(spark, [f"{sys.executable} {script}"])
    assert [r["a"] for r in programs.singer_records(lines, "s", "a int").collect()] == [1] and [r[0] for r in programs.singer_state(lines).collect()] == ['{"at":1}']
    assert [r["a"] for r in programs.airbyte_records(lines, "s", "a int").collect()] == [4]
    with pytest.raises(Exception, match="ended with 3"):
        programs.run_lines(spark, [f"{sys.executable} -c 'exit(3)'"]).collect()


def test_table_formats(spark, tmp_path):
    snaps = [{"snapshot_id": 1, "timestamp_ms": 10, "parent_id": None}, {"snapshot_id": 2, "timestamp_ms": 20, "parent_id": 1}, {"snapshot_id": 3, "timestamp_ms": 30, "parent_id": 2, "operation": "overwrite"}]
    assert tables.select_snapshot(snaps, current=3) == 3 and tables.select_snapshot(snaps, as_of_ms=25) == 2 and tables.select_snapshot(snaps, refs={"tag": 1}, ref="tag") == 1
    assert tables.appended_snapshots(snaps, 1, 2) == [2]
    for call in (lambda: tables.select_snapshot(snaps, snapshot_id=9), lambda: tables.select_snapshot(snaps, as_of_ms=1), lambda: tables.appended_snapshots(snaps, 1, 3), lambda: tables.select_snapshot(snaps, ref="x", as_of_ms=1)):
        with pytest.raises(ContractError):
            call()
    data = spark.createDataFrame([(1, None, 1), (2, "a", 1), (3, "a", 3)], "id int, k string, _sequence int")
    gone = spark.createDataFrame([("a", 2), (None, 2)], "k string, sequence int")
    assert [r["id"] for r in tables.apply_equality_deletes(data, gone, ["k"]).collect()] == [3]
    spark.range(10).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(f"{tmp_path}/t")
    pruned = tables.read_partitioned(spark, f"{tmp_path}/t", where="p = 1")
    assert pruned.count() == 5 and "PartitionFilters: [isnotnull(p" in pruned._jdf.queryExecution().executedPlan().toString()
    events = spark.createDataFrame(
        [('{"operationType":"insert","_id":"t1","fullDocument":{"_id":1,"v":"a"}}',), ('{"operationType":"replace","_id":"t2","fullDocument":{"_id":1,"v":"b"}}',), ('{"operationType":"delete","_id":"t3","documentKey":{"_id":1}}',)], "event string"
    )
    assert [tuple(r) for r in tables.flatten_change_stream(events, "_id int, v string").collect()] == [("insert", "t1", 1, "a"), ("update", "t2", 1, "b"), ("delete", "t3", 1, None)]
    with pytest.raises(Exception, match="invalidate"):
        tables.flatten_change_stream(spark.createDataFrame([('{"operationType":"invalidate"}',)], "event string"), "v string").collect()


def test_catalog_tables(spark, tmp_path):
    spark.range(10).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(f"{tmp_path}/t")
    spark.sql(f"CREATE TABLE sluice_listed (id BIGINT, p BIGINT) USING parquet PARTITIONED BY (p) LOCATION 'file://{tmp_path}/t'")
    try:
        spark.sql("MSCK REPAIR TABLE sluice_listed")
        found = tables.read_catalog_table(spark, "sluice_listed", "p = 1")
        assert sorted(r["id"] for r in found.collect()) == [1, 3, 5, 7, 9] and "PartitionFilters: [isnotnull(p" in found._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(ContractError):
            tables.read_catalog_table(spark, "not_listed")
    finally:
        spark.sql("DROP TABLE sluice_listed")


@pytest.mark.parametrize("dialect", ["postgres", "mysql", "sqlite", "clickhouse"])
def test_queries_run_where_the_dialect_is_spoken(dialect):
    """What a server would be asked, put to engines that take the same quotes."""
    rows = [(i, i % 7 / 2, "F" if i % 3 else "O'x") for i in range(50)]
    scan = databases.Scan("orders", ("k", "v"), ("v >= 1", "s = 'O''x'", "k != 9"), ("k",), None, "k", 11)
    sql, again = databases.build_query(scan, dialect)
    db = duckdb.connect() if dialect == "postgres" else sqlite3.connect(":memory:")
    db.execute("CREATE TABLE orders (k INTEGER, v DOUBLE, s VARCHAR)")
    db.executemany("INSERT INTO orders VALUES (?, ?, ?)", rows)
    want = [(k, v) for k, v, s in rows if v >= 1 and s == "O'x" and k > 11]
    assert db.execute(sql).fetchall() == want and "k != 9" in again


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("unused")).write.parquet(f"{tmp_path}/t.parquet")
    from sluice.plans.frontend import parse_resource
    from sluice.plans.run import Registry, explain, parquet_source

    text = explain(spark, parse_resource("SELECT id FROM upstream(source => 'p', table => 't') WHERE id >= 90"), Registry({"p": parquet_source(str(tmp_path))}))
    Registry({"p": parquet_source(str(tmp_path))}).mount(spark, "mounted", "p", table="t")
    assert spark.sql("SELECT count(*) AS n FROM mounted WHERE id >= 90").first()["n"] == 10
    assert "GreaterThanOrEqual(id,90)" in text and "ReadSchema: struct<id:bigint>" in text
