"""Queries of sources, formats, packages and targets.

What is read back is written first, by tasks into the shared folder; only the 25 nations, a table that does not
grow, pass through the driver into formats that Spark does not write.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.ledger import Ledger
from sluice.operators.contract import Contract, Domain, Range
from sluice.operators.residual import VARIANT_COLUMN
from sluice.operators.routing import with_route
from sluice.plans.frontend import parse_resource
from sluice.plans.registration import decisions, outcome, query, scratch, table, values
from sluice.plans.resource import GUARANTEES, Delete, delivery_guarantee
from sluice.plans.run import Options, Registry, parquet_source, plan, preview, run
from sluice.sinks.lake import Lake, merged_rows
from sluice.sinks.package import Packages
from sluice.sources import databases, files, programs, tables
from sluice.storage import Folder
from sluice.system import check_read_only, mount, system_sql

# -- text formats

_PARTS = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"
_PART_SCHEMA = "p_partkey bigint, p_name string, p_size int, p_retailprice double"


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"), "p_retailprice")


def _files(spark, root: str, suffix: str = "*") -> list[str]:
    return [p for p, *_ in files.resolve(spark, root, suffix) if not p.rsplit("/", 1)[1].startswith(("_", "."))]


@query(f"SELECT k.kind, p.* FROM ({_PARTS}) p, (VALUES ('csv'), ('tsv'), ('psv'), ('custom')) k(kind)".replace("SELECT k.kind, p.*", "SELECT k.kind, p.p_partkey, p.p_name, p.p_size::INT AS p_size, p.p_retailprice"))
def delimited_files(spark, sf_dir):
    out = []
    for kind, sep in (("csv", ","), ("tsv", "\t"), ("psv", "|"), ("custom", ";")):
        root = scratch(spark)
        _parts(spark, sf_dir).write.option("header", True).option("sep", sep).option("escape", '"').csv(root)
        out.append(files.read_delimited(spark, _files(spark, root), _PART_SCHEMA, delimiter=sep).select(F.lit(kind).alias("kind"), "*"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT p_partkey::VARCHAR AS p_partkey, nullif(p_brand, 'Brand#11') AS p_brand, p_size::VARCHAR AS p_size FROM part")
def fixed_width_files(spark, sf_dir):
    root = scratch(spark)
    brand = F.when(F.col("p_brand") == "Brand#11", "N/A").otherwise(F.col("p_brand"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.rpad(F.col("p_partkey").cast("string"), 12, " "), F.rpad(brand, 14, " "), F.lpad(F.col("p_size").cast("string"), 6, " ")).alias("value"))
    parts.write.text(root)
    layout = [("p_partkey", 0, 12), ("p_brand", 12, 14), ("p_size", 26, 6)]
    return files.read_fixed_width(spark, _files(spark, root), layout, null_tokens=("N/A",))


@query("SELECT event_id, user_id, event_type, NULL::VARCHAR AS bad FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT NULL, NULL, NULL, 'broken ' || event_id FROM events WHERE event_id % 10 = 0")
def ndjson_files(spark, sf_dir):
    """Records, and the texts of those that could not be read: one bad record spoils no other."""
    root = scratch(spark)
    events = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    events.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("broken "), "event_id")).otherwise(F.col("value")).alias("value")).write.text(root)
    good, bad = files.read_ndjson(spark, _files(spark, root), T.StructType.fromDDL("event_id bigint, user_id bigint, event_type string"))
    return good.withColumn("bad", F.lit(None).cast("string")).unionByName(bad.select(F.col("_corrupt_record").alias("bad")), allowMissingColumns=True)


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name FROM customer")
def json_documents(spark, sf_dir):
    """One JSON document a file, whose rows stand under a field."""
    root = scratch(spark)
    customers = table(spark, sf_dir, "customer").select("c_nationkey", F.struct(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name").alias("c"))
    documents = customers.groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list("c").alias("rows"))).alias("value"))
    documents.select("value").repartition(25, "value").sortWithinPartitions("value").write.option("maxRecordsPerFile", 1).text(root)
    return files.read_json_document(spark, _files(spark, root), T.StructType.fromDDL("c_custkey bigint, c_name string"), "$.rows")


@query(values([("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "array<bigint>"), ("e", "struct<x:bigint,y:string>"), ("f", "boolean"), ("g", "void")], '"field", type'))
def json_schema_merge(spark, sf_dir):
    root = scratch(spark)
    lines = ['{"a": 1, "b": 1, "c": 1, "d": 1, "e": {"x": 1}, "f": true}', '{"a": null, "b": 2.5, "c": "t", "d": [2, 3], "e": {"y": "z"}, "g": null}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(root)
    found = files.discover_json(spark, _files(spark, root))
    return decisions(spark, [(f.name, f.dataType.simpleString()) for f in found], "field string, type string")


# -- formats that Spark does not write

_NATIONS = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"
_NATION_SCHEMA = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType())])


def _nations(spark, sf_dir) -> list[tuple[int, str]]:
    return [(r[0], r[1]) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]


@query(f"SELECT k.kind, n.* FROM ({_NATIONS}) n, (VALUES ('file'), ('stream')) k(kind)")
def arrow_ipc_files(spark, sf_dir):
    rows, out = _nations(spark, sf_dir), []
    batch = pa.table({"n_name": [n for _, n in rows], "n_nationkey": pa.array([k for k, _ in rows], pa.int32())})
    for kind, new in (("file", pa.ipc.new_file), ("stream", pa.ipc.new_stream)):
        sink = io.BytesIO()
        with new(sink, batch.schema) as writer:
            writer.write_table(batch, max_chunksize=10)
        folder = Folder(spark, scratch(spark))
        folder.write_bytes("nations.arrow", sink.getvalue())
        out.append(files.read_arrow_ipc(spark, [f"{folder.path}/nations.arrow"], _NATION_SCHEMA).select(F.lit(kind).alias("kind"), "*"))
    return out[0].unionByName(out[1])


# -- databases, services and table formats


def _local(path: str) -> str:
    """The path of a shared folder as a database file needs it."""
    from sluice.errors import ContractError

    plain = path.removeprefix("file://")
    if "://" in plain:
        raise ContractError(f"{path} holds no database files")
    return plain


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name) FROM nation WHERE n_nationkey % 2 = 0")
def sqlite_table(spark, sf_dir):
    """A SQLite file: loaded, merged into, and read back by ranges of its rows in tasks."""
    from sluice.sinks.databases import Database

    folder = Folder(spark, scratch(spark))
    folder.write("here", "")
    db = Database(f"{_local(folder.path)}/nations.db", "sqlite")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    even = nations.where("n_nationkey % 2 = 0").select("n_nationkey", F.upper("n_name").alias("n_name"))
    db.deliver("nations", nations, "a", "merge", ["n_nationkey"])
    for _ in range(2):  # the second time is the first one's receipt
        db.deliver("nations", even.unionByName(even.withColumn("n_nationkey", F.col("n_nationkey") + 100)), "b", "merge", ["n_nationkey"])
    return databases.read_sqlite(spark, db.path, "nations", partitions=4)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN n_name || '!' ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 3 <> 0")
def duckdb_target(spark, sf_dir):
    """A DuckDB file: a package, then changes with deletes, each in one transaction."""
    from sluice.sinks.databases import Database

    folder = Folder(spark, scratch(spark))
    folder.write("here", "")
    db = Database(f"{_local(folder.path)}/nations.duckdb", "duckdb")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    db.deliver("nations", nations, "a", "append", staging=folder.path)
    changes = nations.where("n_nationkey % 3 <> 2").select("n_nationkey", F.concat("n_name", F.lit("!")).alias("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "delete").otherwise("update").alias("op"))
    db.deliver("nations", changes, "b", "cdc_apply", ["n_nationkey"], Delete("hard"), staging=folder.path)
    return spark.createDataFrame(db.query("SELECT n_nationkey, n_name FROM nations"), "n_nationkey bigint, n_name string")


@query("SELECT k.kind, n.n_nationkey::BIGINT AS n_nationkey, n.n_name FROM nation n, (VALUES ('page'), ('offset'), ('cursor'), ('link')) k(kind)")
def rest_pages(spark, sf_dir):
    """Endpoints read in parallel, page by page, from a service that refuses every first request of a page."""
    import http.server
    import threading
    import urllib.parse

    from sluice.sources.rest import read_rest
    from sluice.storage import cut

    rows = [{"n_nationkey": k, "n_name": n} for k, n in sorted(_nations(spark, sf_dir))]
    refused: set[str] = set()

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            if self.path not in refused:
                refused.add(self.path)
                self.send_response(503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            at = urllib.parse.urlsplit(self.path)
            asked = dict(urllib.parse.parse_qsl(at.query))
            start = (int(asked["page"]) - 1) * 10 if "page" in asked else int(asked.get("offset", asked.get("cursor", 0)))
            more = start + 10 < len(rows)
            body = {"data": {"items": rows[start : start + 10]}} | ({"next_cursor": str(start + 10)} if more else {})
            self.send_response(200)
            if more and at.path == "/link":
                self.send_header("Link", f'</link?cursor={start + 10}>; rel="next"')
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_) -> None:
            pass

    host = spark.sparkContext.getConf().get("spark.driver.host") or "127.0.0.1"
    server = http.server.ThreadingHTTPServer(("0.0.0.0", 0), Service)  # noqa: S104
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        kinds = ("page", "offset", "cursor", "link")
        endpoint = lambda k: {"url": f"http://{host}:{server.server_port}/{k}", "records": "data.items", "pagination": {"kind": k, "size": 10}, "allowed_hosts": [host]}
        parts = [read_rest(spark, [endpoint(k)], "n_nationkey bigint, n_name string").select(F.lit(k).alias("kind"), "*") for k in kinds]
        return cut(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    finally:
        server.shutdown()
        server.server_close()


def _avro(kind, value) -> bytes:
    """A value in Avro's binary form."""
    if isinstance(kind, list):
        at = kind.index("null") if value is None else next(i for i, k in enumerate(kind) if k != "null")
        return _zigzag(at) + (b"" if value is None else _avro(kind[at], value))
    name = kind["type"] if isinstance(kind, dict) else kind
    if name in ("int", "long"):
        return _zigzag(value)
    if name == "string":
        return _zigzag(len(value.encode())) + value.encode()
    if name == "array":
        return (_zigzag(len(value)) + b"".join(_avro(kind["items"], v) for v in value) if value else b"") + _zigzag(0)
    return b"".join(_avro(f["type"], value[f["name"]]) for f in kind["fields"])


def _container(kind: dict, rows: list[dict]) -> bytes:
    body = b"".join(_avro(kind, r) for r in rows)
    head = b"Obj\x01" + _zigzag(1) + _avro("string", "avro.schema") + _avro("string", json.dumps(kind)) + _zigzag(0) + b"0" * 16
    return head + _zigzag(len(rows)) + _zigzag(len(body)) + body + b"0" * 16


def _record(name: str, **fields) -> dict:
    return {"type": "record", "name": name, "fields": [{"name": k, "type": v} for k, v in fields.items()]}


_MANIFEST = _record(
    "entry", status="int", snapshot_id=["null", "long"], sequence_number=["null", "long"],
    data_file=_record("file", content="int", file_path="string", file_format="string", equality_ids=["null", {"type": "array", "items": "int"}]),
)
_LISTED = _record("manifest", manifest_path="string", sequence_number="long", added_snapshot_id="long")


@query(
    """SELECT s.selector, o_orderkey, o_totalprice AS price FROM orders, (VALUES ('current'), ('tag'), ('appended')) s(selector)
    WHERE CASE s.selector WHEN 'current' THEN o_orderkey % 5 <> 0 WHEN 'tag' THEN o_orderstatus = 'F' ELSE o_orderstatus <> 'F' END"""
)
def iceberg_snapshots(spark, sf_dir):
    """A table of two appends and a delete by key, read by its own metadata: as it is, by tag, and what the second append added; one column was renamed since."""
    from sluice.sources.iceberg import read_iceberg

    folder = Folder(spark, scratch(spark))
    ids = {"o_orderkey": 1, "o_totalprice": 2}
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")

    def write(df: DataFrame, name: str) -> list[str]:
        df.select(*[F.col(c).alias(c, metadata={"parquet.field.id": ids[c]}) for c in df.columns]).write.parquet(f"{folder.path}/data/{name}")
        return [p for p, *_ in folder.glob(f"data/{name}/*.parquet")]

    first = write(orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), "first")
    second = write(orders.where("o_orderstatus <> 'F'").drop("o_orderstatus"), "second")
    gone = write(orders.where("o_orderkey % 5 = 0").select("o_orderkey"), "gone")
    listed, snapshots = [], []
    for i, (content, paths) in enumerate(((0, first), (0, second), (2, gone)), 1):
        entries = [{"status": 1, "snapshot_id": None, "sequence_number": None, "data_file": {"content": content, "file_path": p, "file_format": "PARQUET", "equality_ids": [1] if content else None}} for p in paths]
        folder.write_bytes(f"metadata/m{i}.avro", _container(_MANIFEST, entries))
        listed.append({"manifest_path": f"{folder.path}/metadata/m{i}.avro", "sequence_number": i, "added_snapshot_id": i})
        folder.write_bytes(f"metadata/snap{i}.avro", _container(_LISTED, listed))
        snapshots.append({"snapshot-id": i, "parent-snapshot-id": i - 1 or None, "timestamp-ms": i, "manifest-list": f"{folder.path}/metadata/snap{i}.avro", "summary": {"operation": "delete" if content else "append"}})
    kinds = {"o_orderkey": "long", "o_totalprice": "double"}
    shape = {"schema-id": 0, "type": "struct", "fields": [{"id": ids[c], "name": "price" if c == "o_totalprice" else c, "type": t} for c, t in kinds.items()]}
    meta = {"format-version": 2, "current-snapshot-id": 3, "snapshots": snapshots, "refs": {"first": {"snapshot-id": 1, "type": "tag"}}, "current-schema-id": 0, "schemas": [shape]}
    folder.write("metadata/v1.metadata.json", json.dumps(meta))
    parts = {"current": read_iceberg(spark, folder.path), "tag": read_iceberg(spark, folder.path, ref="first"), "appended": read_iceberg(spark, folder.path, after=1, snapshot_id=2)}
    named = [df.select(F.lit(k).alias("selector"), "*") for k, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _zigzag(n: int) -> bytes:
    n, out = n << 1 ^ n >> 63, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


@query(_NATIONS)
def avro_files(spark, sf_dir):
    shape = _record("nation", n_nationkey="int", n_name=["null", "string"])
    folder = Folder(spark, scratch(spark))
    folder.write_bytes("nations.avro", _container(shape, [{"n_nationkey": k, "n_name": n} for k, n in _nations(spark, sf_dir)]))
    return files.read_avro(spark, [f"{folder.path}/nations.avro"], _NATION_SCHEMA)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_nationkey / 2 AS half FROM nation")
def protobuf_files(spark, sf_dir):
    messages = [b"\x08" + _varint(k) + b"\x12" + _varint(len(n.encode())) + n.encode() + b"\x19" + struct.pack("<d", k / 2) for k, n in _nations(spark, sf_dir)]
    folder = Folder(spark, scratch(spark))
    folder.write_bytes("nations.pb", b"".join(_varint(len(m)) + m for m in messages))
    fields = {1: ("n_nationkey", "int64"), 2: ("n_name", "string"), 3: ("half", "double")}
    return files.read_protobuf(spark, [f"{folder.path}/nations.pb"], fields, T.StructType.fromDDL("n_nationkey bigint, n_name string, half double"))


@query("SELECT k.kind, n.n_name FROM nation n, (VALUES ('gz'), ('bz2'), ('xz'), ('zst'), ('lz4'), ('br')) k(kind)")
def compressed_files(spark, sf_dir):
    import zstandard

    text = "".join(f"{n}\n" for _, n in _nations(spark, sf_dir)).encode()
    made = {"gz": gzip.compress(text), "bz2": bz2.compress(text), "xz": lzma.compress(text), "zst": zstandard.compress(text), "lz4": pa.Codec("lz4").compress(text, asbytes=True), "br": pa.Codec("brotli").compress(text, asbytes=True)}
    folder = Folder(spark, scratch(spark))
    for kind, data in made.items():
        folder.write_bytes(f"nations.{kind}", data)
    lines = files.read_decoded_lines(spark, [folder.path])
    return lines.select(F.element_at(F.split("path", r"\."), -1).alias("kind"), F.col("value").alias("n_name"))


@query("SELECT e.encoding, c.c_custkey::BIGINT AS c_custkey, 'Zürich ' || c.c_name AS label FROM customer c, (VALUES ('utf8'), ('utf16le'), ('iso-8859-1'), ('windows-1252')) e(encoding)")
def encoded_files(spark, sf_dir):
    out = None
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Zürich "), "c_name").alias("label"))
    for name, java in (("utf8", "UTF-8"), ("utf16le", "UTF-16LE"), ("iso-8859-1", "ISO-8859-1"), ("windows-1252", "windows-1252")):
        root = scratch(spark)
        files._encoding(name, spark)
        customers.write.option("header", True).option("encoding", java).csv(root)
        terminator = "\n" if name == "utf16le" else None
        part = files.read_delimited(spark, _files(spark, root), "c_custkey bigint, label string", encoding=name, terminator=terminator).select(F.lit(name).alias("encoding"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# -- other sources


@query("SELECT 'orders.parquet' AS name, 'ok' AS outcome UNION ALL SELECT v.* FROM (VALUES ('../orders.parquet', 'ContractError'), ('/etc/passwd', 'ContractError'), ('s3://b/x', 'ContractError')) v(name, outcome)")
def file_resolution(spark, sf_dir):
    """Patterns stay under their root."""
    found = [p.rstrip("/").rsplit("/", 1)[1] for p, *_ in files.resolve(spark, sf_dir, "orders.parque[t]")] or [n for n, *_ in Folder(spark, sf_dir).list() if n == "orders.parquet"]
    bad = [(p, outcome(lambda p=p: files.resolve(spark, sf_dir, p))) for p in ("../orders.parquet", "/etc/passwd", "s3://b/x")]
    return decisions(spark, [*((n, "ok") for n in found), *bad], "name string, outcome string")


_TEMPLATES = [
    ("h/{08..10}.gz", "h/08.gz h/09.gz h/10.gz"), ("{2023-11..2024-02}", "2023-11 2023-12 2024-01 2024-02"), ("y{1..2}/m{3..4}", "y1/m3 y1/m4 y2/m3 y2/m4"), ("plain", "plain"),
    ("{a..b}", "ContractError"), ("{5..1}", "ContractError"), ("{1..99999}", "ContractError"),
]


@query(values(_TEMPLATES, "template, places"))
def template_expansion(spark, sf_dir):
    """Places of a template, numbers as wide as written and months over the year's end; none and too many are refused."""
    rows = []
    for template, _ in _TEMPLATES:
        failed = outcome(lambda t=template: files.expand_template(t))
        rows.append((template, " ".join(files.expand_template(template)) if failed == "ok" else failed))
    return decisions(spark, rows, "template string, places string")


_SCAN = databases.Scan("shop.orders", ("o_orderkey", "o_totalprice"), ("o_totalprice >= 10", "o_orderstatus != 'F'"), ("o_orderkey",), None, "o_orderkey", 41)
_SQL = "SELECT {q}o_orderkey{q}, {q}o_totalprice{q} FROM {q}shop{q}.{q}orders{q} WHERE {q}o_totalprice{q} >= 10 AND {q}o_orderkey{q} > 41 ORDER BY {q}o_orderkey{q}"


@query(values([(d, _SQL.format(q=q), "o_orderstatus != 'F'" if d != "sqlite" else "o_totalprice >= 10; o_orderstatus != 'F'") for d, q in (("postgres", '"'), ("mysql", "`"), ("sqlite", '"'), ("clickhouse", "`"))], "dialect, sql, again"))
def database_queries(spark, sf_dir):
    """What databases are asked: their quotes, the filters they answer, the committed cursor; and what Spark filters again."""
    rows = []
    for dialect in ("postgres", "mysql", "sqlite", "clickhouse"):
        sql, again = databases.build_query(_SCAN, dialect)
        rows.append((dialect, sql, "; ".join(again)))
    return decisions(spark, rows, "dialect string, sql string, again string")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) // 2 FROM orders)")
def cursor_resume(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    committed = orders.agg(F.max("o_orderkey")).first()[0] // 2
    return databases.resume_after(orders, "o_orderkey", committed)


@query("SELECT CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, 't' || event_id AS resume_token, user_id AS _id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events")
def change_stream(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "replace").otherwise("update")
    whole, key = F.to_json(F.struct(F.col("user_id").alias("_id"), F.col("value").alias("v"))), F.to_json(F.struct(F.col("user_id").alias("_id")))
    body = F.struct(kind.alias("operationType"), F.concat(F.lit("t"), "event_id").alias("_id"), F.when(kind != "delete", whole).alias("fullDocument"), key.alias("documentKey"))
    return tables.flatten_change_stream(table(spark, sf_dir, "events").select(F.to_json(body).alias("event")), "_id bigint, v double")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partitioned_table(spark, sf_dir):
    """Folders are pruned by their partition before any file is opened."""
    root = scratch(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(root)
    return tables.read_partitioned(spark, root, where="o_orderstatus = 'F'")


_SNAPSHOTS = [{"snapshot_id": i, "timestamp_ms": 10 * i, "parent_id": i - 1 or None, "operation": "overwrite" if i == 4 else "append"} for i in (1, 2, 3, 4)]
_SELECTED = [("current", "4"), ("tag", "2"), ("id 3", "3"), ("as of 25", "2"), ("as of 5", "ContractError"), ("id 9", "ContractError"), ("appended after 1", "2,3"), ("appended after 3", "ContractError")]


@query(values(_SELECTED, "selector, snapshot"))
def snapshot_selection(spark, sf_dir):
    calls = {
        "current": lambda: tables.select_snapshot(_SNAPSHOTS, current=4), "tag": lambda: tables.select_snapshot(_SNAPSHOTS, refs={"t": 2}, ref="t"), "id 3": lambda: tables.select_snapshot(_SNAPSHOTS, snapshot_id=3),
        "as of 25": lambda: tables.select_snapshot(_SNAPSHOTS, as_of_ms=25), "as of 5": lambda: tables.select_snapshot(_SNAPSHOTS, as_of_ms=5), "id 9": lambda: tables.select_snapshot(_SNAPSHOTS, snapshot_id=9),
        "appended after 1": lambda: ",".join(map(str, tables.appended_snapshots(_SNAPSHOTS, 1, 3))), "appended after 3": lambda: tables.appended_snapshots(_SNAPSHOTS, 3, 4),
    }
    return decisions(spark, [(k, str(f()) if (failed := outcome(f)) == "ok" else failed) for k, f in calls.items()], "selector string, snapshot string")


@query("SELECT p::INT AS part, i::BIGINT AS i, i * p AS product FROM range(0, 4) t(p), range(0, 20000) s(i)")
def python_resource(spark, sf_dir):
    """A generator resource, one call a partition, in tasks: batches and single rows."""

    @programs.resource("part int, i bigint, product bigint", partitions=(0, 1, 2, 3))
    def made(part):
        half = range(10_000)
        yield pa.table({"product": [i * part for i in half], "i": list(half), "part": pa.array([part] * 10_000, pa.int32())})
        for i in range(10_000, 20_000):
            yield {"part": part, "i": i, "product": i * part}

    return programs.read_python(spark, made)


_HINTS = [("append", "append"), ("replace", "replace"), ("merge", "merge"), ("skip", "ContractError")]


@query(values(_HINTS, "hint, disposition"))
def foreign_hints(spark, sf_dir):
    rows = []
    for hint, _ in _HINTS:
        made = lambda hint=hint: programs.from_dlt({"name": "n", "primary_key": "id", "write_disposition": hint}, lambda: [], "id int")
        rows.append((hint, made().disposition if (failed := outcome(made)) == "ok" else failed))
    return decisions(spark, rows, "hint string, disposition string")


@query("SELECT k.protocol, r.k::BIGINT AS k, r.v FROM (VALUES ('ndjson'), ('singer'), ('airbyte')) k(protocol), (VALUES (1, 'a'), (2, 'b')) r(k, v)")
def program_protocols(spark, sf_dir):
    """Programs that write NDJSON, Singer or Airbyte messages to their output, run in tasks."""
    lines = {
        "ndjson": ['{"k":1,"v":"a"}', "", '{"k":2,"v":"b"}'],
        "singer": ['{"type":"SCHEMA","stream":"s"}', '{"type":"RECORD","stream":"s","record":{"k":1,"v":"a"}}', '{"type":"RECORD","stream":"t","record":{"k":9}}', '{"type":"RECORD","stream":"s","record":{"k":2,"v":"b"}}', '{"type":"STATE","value":{}}'],
        "airbyte": ['{"type":"LOG"}', '{"type":"RECORD","record":{"stream":"s","data":{"k":1,"v":"a"},"emitted_at":1}}', '{"type":"RECORD","record":{"stream":"s","data":{"k":2,"v":"b"},"emitted_at":2}}'],
    }
    said = programs.run_lines(spark, [f"printf '%s\\n' {' '.join(repr(x) if x else repr(' ') for x in v)}" for v in lines.values()])
    of = lambda i: said.where(F.col("command") == i)
    parts = {"ndjson": programs.ndjson_records(of(0), "k bigint, v string"), "singer": programs.singer_records(of(1), "s", "k bigint, v string"), "airbyte": programs.airbyte_records(of(2), "s", "k bigint, v string")}
    named = [df.select(F.lit(k).alias("protocol"), "k", "v") for k, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


# -- packages

_DELIVERED = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000"
_RESOURCE = "RESOURCE TARGET orders_out DISPOSITION APPEND TRUST GOVERNED AS " + _DELIVERED.replace("FROM orders", "FROM upstream(source => 't', table => 'orders')")


def _world(spark, sf_dir) -> tuple[Registry, Lake, Packages, Ledger]:
    root = scratch(spark)
    return Registry({"t": parquet_source(sf_dir)}), Lake(spark, root), Packages(spark, f"{root}/packages"), Ledger(Folder(spark, root))


@query(_DELIVERED)
def package_replay(spark, sf_dir):
    registry, lake, packages, ledger = _world(spark, sf_dir)
    done = run(spark, _RESOURCE, registry, lake, packages, ledger, package_id="p1")
    return tables.replay(spark, done.package.path)


@query(_DELIVERED)
def preview_rows(spark, sf_dir):
    """Rows that would be accepted; nothing is written."""
    return preview(spark, _RESOURCE, Registry({"t": parquet_source(sf_dir)}), rows=(1 << 31) - 1)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def segments_in_order(spark, sf_dir):
    """Segments of a package, read one after the other, give its rows in their order."""
    packages = Packages(spark, scratch(spark))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    built = packages.build("p1", orders, order_by=["o_orderkey"], target_rows=500)
    rows = spark.read.parquet(f"{built.path}/segments")
    bounds = rows.groupBy("_segment").agg(F.min("o_orderkey").alias("lo"), F.count(F.lit(1)).alias("n"))
    # segments follow each other in the package's order, so a row's ordinal is its place in its segment after those before
    from pyspark.sql import Window as W

    within = F.row_number().over(W.partitionBy("_segment").orderBy("o_orderkey")) - 1
    assert bounds.where(F.col("n") > 500).isEmpty()
    return rows.select("o_orderkey", "o_totalprice", (F.col("_segment") * 500 + within).cast("bigint").alias("ordinal"))


@query("SELECT count(*)::BIGINT AS rows, true AS faithful, 'archived' AS status, 'ok' AS verified FROM orders")
def package_archive(spark, sf_dir):
    packages = Packages(spark, scratch(spark))
    packages.build("p1", table(spark, sf_dir, "orders"))
    verified = outcome(lambda: packages.verify("p1"))
    report = packages.archive("p1", f"{scratch(spark)}/archive")
    return decisions(spark, [(report["rows"], report["faithful"], packages.manifest("p1")["status"], verified)], "rows bigint, faithful boolean, status string, verified string")


_LIFE = [("packaged", "ok"), ("loading", "ok"), ("loaded", "ok"), ("loading", "DeliveryError"), ("committed", "ok"), ("checkpointed", "ok"), ("planned", "DeliveryError"), ("archived", "ok")]


@query(values([(i, *x) for i, x in enumerate(_LIFE)], "step, status, outcome"))
def package_life_cycle(spark, sf_dir):
    packages = Packages(spark, scratch(spark))
    packages.build("p1", table(spark, sf_dir, "region"))
    return decisions(spark, [(i, s, outcome(lambda s=s: packages.set_status("p1", s))) for i, (s, _) in enumerate(_LIFE)], "step int, status string, outcome string")


# -- targets


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def lake_append(spark, sf_dir):
    """Rows are added once a package, however often it is delivered."""
    lake = Lake(spark, scratch(spark))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for token, rows in (("a", orders), ("b", orders.where("o_orderstatus = 'F'")), ("a", orders), ("b", orders)):
        lake.deliver("orders", rows.drop("o_orderstatus"), token, "append")
    return lake.read("orders")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def lake_replace(spark, sf_dir):
    lake = Lake(spark, scratch(spark))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    lake.deliver("orders", orders.drop("o_orderstatus"), "a", "replace")
    lake.deliver("orders", orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), "b", "replace")
    return lake.read("orders")


@query("SELECT 'string=' || o_orderstatus AS output, o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders")
def lake_routes(spark, sf_dir):
    """A package written once, an output a status; all outputs change together."""
    lake = Lake(spark, scratch(spark))
    orders = with_route(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")
    lake.deliver_routed("orders", orders, "a", "merge", 5, ["o_orderkey"])
    receipts = lake.deliver_routed("orders", orders.withColumn("o_totalprice", F.col("o_totalprice") + 1), "b", "merge", 5, ["o_orderkey"])
    out = None
    for r in receipts:
        part = lake.read(r.target).select(F.lit(r.target.rpartition("/")[2]).alias("output"), "o_orderkey", "o_totalprice")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'discount' AS rule_id, l_discount::VARCHAR AS value FROM lineitem WHERE l_discount > 0.05")
def quarantine_mirror(spark, sf_dir):
    """Records of broken rules beside a target, written once a package."""
    from sluice.operators.contract import validate

    root = scratch(spark)
    lake = Lake(spark, root)
    evidence = validate(table(spark, sf_dir, "lineitem"), Contract((Range("discount", "l_discount", None, "0.05"),)), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).quarantine
    for _ in range(2):
        lake.mirror_quarantine("lines", evidence, "p1")
    return spark.read.parquet(f"{root}/quarantine/lines/p1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rule_id", "value")


@query(
    """SELECT d.disposition, r.receipt, CASE WHEN NOT r.receipt THEN 'at_least_once' ELSE d.confirmed END AS guarantee
    FROM (VALUES ('append', 'per_package'), ('replace', 'per_target'), ('merge', 'per_key'), ('cdc_apply', 'per_position')) d(disposition, confirmed), (VALUES (true), (false)) r(receipt)"""
)
def delivery_guarantees(spark, sf_dir):
    return decisions(spark, [(d, r, delivery_guarantee(d, r)) for d in GUARANTEES for r in (True, False)], "disposition string, receipt boolean, guarantee string")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderstatus = 'F'")
def anti_join_merge(spark, sf_dir):
    """A merge as copy and insert: what the package does not touch, and the package."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    stage = orders.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    kept = orders.drop("o_orderstatus").join(stage, "o_orderkey", "left_anti")
    merged = merged_rows(orders.drop("o_orderstatus"), stage, ["o_orderkey"], ["o_orderkey", "o_totalprice"]).drop("__change")
    return kept.unionByName(stage).intersectAll(merged)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS o_totalprice, '{\"v\":1,\"fields\":{\"/o_orderpriority\":{\"arrow_type\":\"string\",\"encoding\":\"text\",\"value\":\"' || o_orderpriority || '\"}}}' AS _variant FROM orders")
def governed_schema(spark, sf_dir):
    """A declared schema: fields without a place go into the variant column, missing ones are null."""
    sql = "RESOURCE TRUST GOVERNED AS SELECT * FROM upstream(source => 'o')"
    opened = lambda s: table(s, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority")
    options = Options(Contract((Domain("any", "o_orderkey", ()),)[:0]), schema=T.StructType.fromDDL("o_orderkey bigint, o_totalprice double"))
    return plan(spark, parse_resource(sql), Registry({"o": opened}), options).accepted.select("o_orderkey", "o_totalprice", VARIANT_COLUMN)


@query(values([("ignore", "ignored_delete"), ("hard", "hard_deleted"), ("soft", "soft_deleted")], "policy, change"))
def delete_policies(spark, sf_dir):
    from sluice.sinks.lake import applied_changes

    out = None
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(False).alias("gone"))
    gone = nations.where("n_nationkey = 3").select("n_nationkey", F.lit("delete").alias("op"))
    for policy in ("ignore", "hard", "soft"):
        columns = ["n_nationkey"] + (["gone"] if policy == "soft" else [])
        rows = applied_changes(nations, gone, ["n_nationkey"], columns, "op", Delete(policy, "gone" if policy == "soft" else None)).where("__change <> 'kept'")
        part = rows.select(F.lit(policy).alias("policy"), F.col("__change").alias("change"))
        out = part if out is None else out.unionByName(part)
    return out


# -- system tables


def _two_runs(spark, sf_dir):
    registry, lake, packages, ledger = _world(spark, sf_dir)
    options = Options(Contract((Domain("status", "o_orderstatus", ("F", "O")),)))
    for name in ("p1", "p2"):
        run(spark, _RESOURCE.replace("APPEND", "REPLACE"), registry, lake, packages, ledger, options, package_id=name)
    return mount(spark, lake, packages, ledger, [parse_resource(_RESOURCE)])


_COLUMNS = {
    "compilation_resources": 6, "manifest_project": 2, "manifest_inputs": 3, "manifest_resources": 5, "manifest_fields": 6, "manifest_semantics": 3, "manifest_lineage": 4, "manifest_diagnostics": 3, "checkpoints": 19, "packages": 9,
    "package_files": 5, "package_segments": 7, "package_receipts": 19, "package_receipt_segments": 6,
}


@query(values(list(_COLUMNS.items()), '"table", columns'))
def system_tables(spark, sf_dir):
    return decisions(spark, [(name, len(df.columns)) for name, df in _two_runs(spark, sf_dir).items()], "table string, columns int")


@query("SELECT p.id AS package_id, 'replace' AS disposition, count(*)::BIGINT AS rows_written, 1::BIGINT AS receipts, p.id = 'p2' AS is_head, 'checkpointed' AS status FROM orders, (VALUES ('p1'), ('p2')) p(id) WHERE o_totalprice > 1000 AND o_orderstatus IN ('F', 'O') GROUP BY p.id")
def system_joins(spark, sf_dir):
    """Joins, USING and aggregates over the system tables of two runs."""
    _two_runs(spark, sf_dir)
    return system_sql(
        spark,
        """WITH r AS (SELECT package_id, disposition, max(rows_written) AS rows_written, count(DISTINCT receipt_id) AS receipts, min(receipt_id) AS receipt_id FROM package_receipts WHERE package_id = 'p1' GROUP BY package_id, disposition
        UNION ALL SELECT package_id, disposition, max(rows_written), count(DISTINCT receipt_id), max(receipt_id) FROM package_receipts WHERE package_id = 'p2' GROUP BY package_id, disposition)
        SELECT p.package_id, r.disposition, r.rows_written, r.receipts, p.package_id = 'p2' AS is_head, p.status FROM packages p JOIN r USING (package_id) CROSS JOIN manifest_project LEFT JOIN checkpoints c ON c.receipt_id = r.receipt_id
        GROUP BY p.package_id, r.disposition, r.rows_written, r.receipts, p.status""",
    )


@query(values([("p1", '"t"', '"orders_out"', "loads"), ("p2", '"t"', '"orders_out"', "loads")], "package_id, from_json, to_json, relation"))
def lineage_edges(spark, sf_dir):
    edges = _two_runs(spark, sf_dir)["manifest_lineage"]
    return edges.select(F.split("edge_id", "-")[0].alias("package_id"), "from_json", "to_json", "relation")


_GUARDED = [
    ("SELECT 1", "ok"), ("WITH a AS (SELECT 1) SELECT * FROM a", "ok"), ("select count(*) from packages;", "ok"), ("SELECT 'DROP TABLE x' AS text", "ok"), ("SELECT 1; SELECT 2", "AdmissionError"), ("DROP TABLE packages", "AdmissionError"),
    ("INSERT INTO packages SELECT 1", "AdmissionError"), ("WITH a AS (SELECT 1) DELETE FROM packages", "AdmissionError"), ("SELECT * FROM (UPDATE packages SET x = 1)", "AdmissionError"), ("EXPLAIN SELECT 1", "AdmissionError"), ("", "AdmissionError"),
]


@query(values(_GUARDED, "sql, outcome"))
def read_only_guard(spark, sf_dir):
    return decisions(spark, [(s, outcome(lambda s=s: check_read_only(s))) for s, _ in _GUARDED], "sql string, outcome string")
