"""Files of many formats as DataFrames, and which of them have changed.

Columnar and text formats go through Spark's own readers; formats that Spark lacks are decoded
whole-file in tasks (``binaryFile``), never on the driver.
"""

from __future__ import annotations

import bz2
import gzip
import io
import itertools
import json
import lzma
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ContractError, SchemaError
from sluice.operators.schema import merge_json_types
from sluice.storage import Folder

_ENCODINGS = {"auto": "UTF-8", "utf8": "UTF-8", "utf16le": "UTF-16LE", "utf16be": "UTF-16BE", "windows-1252": "windows-1252", "iso-8859-1": "ISO-8859-1"}


def resolve(spark: SparkSession, root: str, pattern: str) -> list[tuple[str, int, int]]:
    """(path, bytes, change time) of the files under ``root`` that a relative pattern names; ``..`` is refused."""
    if pattern.startswith("/") or ".." in pattern.split("/") or "://" in pattern:
        raise ContractError(f"{pattern} leaves its root")
    return Folder(spark, root).glob(pattern)


def expand_template(template: str, most: int = 10_000) -> list[str]:
    """URLs of a template with ``{a..b}`` ranges of numbers (padded as written) or of months ``{2024-01..2024-12}``."""
    parts = re.split(r"\{([^{}]*)\}", template)
    choices: list[list[str]] = []
    for i, part in enumerate(parts):
        if not i % 2:
            choices.append([part])
            continue
        if m := re.fullmatch(r"(\d{4})-(\d{2})\.\.(\d{4})-(\d{2})", part):
            first, last = (int(m[1]) * 12 + int(m[2]) - 1, int(m[3]) * 12 + int(m[4]) - 1)
            choices.append([f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(first, last + 1)])
        elif m := re.fullmatch(r"(\d+)\.\.(\d+)", part):
            width = len(m[1]) if m[1].startswith("0") else 0
            choices.append([str(k).zfill(width) for k in range(int(m[1]), int(m[2]) + 1)])
        else:
            raise ContractError(f"unknown range {{{part}}}")
    total = 1
    for c in choices:
        total *= len(c)
    if not total or total > most:
        raise ContractError(f"{template} names {total} places; 1 to {most} are allowed")
    return ["".join(p) for p in itertools.product(*choices)]


def manifest(files: list[tuple[str, int, int]]) -> tuple[tuple[str, str], ...]:
    """Identities of files: size and change time."""
    return tuple((path, f"{size}:{changed}") for path, size, changed in files)


def changed_files(current: DataFrame, committed: DataFrame) -> DataFrame:
    """(path, identity) rows of ``current`` that are new or differ from what was committed."""
    return current.join(committed.select("path", "identity"), ["path", "identity"], "left_anti")


def pick_files(disposition: str, current: tuple[tuple[str, str], ...], committed: tuple[tuple[str, str], ...]) -> list[str]:
    """Paths to read: for append those that changed since the committed manifest, else all."""
    if disposition != "append":
        return [p for p, _ in current]
    have = dict(committed)
    return [p for p, identity in current if have.get(p) != identity]


# -- Spark's own formats ---------------------------------------------------------------------


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths)


def read_delimited(
    spark: SparkSession,
    paths: list[str],
    schema: str | T.StructType | None = None,
    *,
    delimiter: str = ",",
    header: bool = True,
    header_validation: bool = True,
    quote: str = '"',
    escape: str = '"',
    terminator: str | None = None,
    comment: str | None = None,
    truncated_rows: bool = False,
    encoding: str = "auto",
) -> DataFrame:
    """Delimited text; all columns are texts unless a schema is given.  Short rows fail unless ``truncated_rows``."""
    options = {"sep": delimiter, "header": header, "quote": quote, "escape": escape, "encoding": _encoding(encoding, spark), "enforceSchema": not (header and header_validation)}
    options["mode"] = "PERMISSIVE" if truncated_rows else "FAILFAST"
    if terminator is not None:
        options["lineSep"] = terminator
    else:
        options["multiLine"] = False
    if comment is not None:
        options["comment"] = comment
    _refuse_undecoded(paths)
    reader = spark.read.options(**{k: v if isinstance(v, str) else str(v).lower() for k, v in options.items()})
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(paths)


def read_fixed_width(
    spark: SparkSession, paths: list[str], layout: list[tuple[str, int, int]], *, null_tokens: tuple[str, ...] = (), unit: str = "char", encoding: str = "utf8", trim: bool = True
) -> DataFrame:
    """Lines cut at (name, start from 0, length); all columns are texts; short lines give null."""
    if unit not in ("char", "byte"):
        raise ContractError(f"unknown unit {unit}")
    _refuse_undecoded(paths)
    lines = spark.read.text(paths) if _encoding(encoding, spark) == "UTF-8" else spark.read.option("encoding", _encoding(encoding)).csv(paths, sep="\x00", quote="", schema="value string")
    out = []
    for name, start, length in layout:
        if unit == "char":
            value = F.substring(F.col("value"), F.lit(start + 1), F.lit(length))
        else:
            value = F.decode(F.substring(F.encode("value", _encoding(encoding)), F.lit(start + 1), F.lit(length)), _encoding(encoding))
        value = F.trim(value) if trim else value
        missing = (F.char_length("value") <= start) | value.isin(*null_tokens) if null_tokens else F.char_length("value") <= start
        out.append(F.when(~missing, value).alias(name))
    return lines.select(*out)


def read_ndjson(spark: SparkSession, paths: list[str], schema: T.StructType, corrupt: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(records, records that could not be read as texts); one bad record spoils no other."""
    _refuse_undecoded(paths)
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(paths)
    parsed = spark.read.text(paths).select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r"), "value")
    bad = parsed.where(F.col(f"r.{corrupt}").isNotNull()).select(F.col("value").alias(corrupt))
    return rows.where(F.col(corrupt).isNull()).drop(corrupt), bad


def read_json_document(spark: SparkSession, paths: list[str], element: T.StructType, selector: str = "$") -> DataFrame:
    """Rows of one JSON array per file: the whole document, or its ``$.field``."""
    if not re.fullmatch(r"\$(\.[A-Za-z_][A-Za-z0-9_]*)?", selector):
        raise ContractError(f"selector {selector} is neither $ nor $.field")
    whole = spark.read.text(paths, wholetext=True)
    text = F.col("value") if selector == "$" else F.get_json_object("value", selector)
    return whole.select(F.explode(F.from_json(text, T.ArrayType(element))).alias("r")).select("r.*")


def discover_json(spark: SparkSession, paths: list[str]) -> T.StructType:
    """The schema that all records of NDJSON files fit, by the merge of JSON types.

    Each task folds its own records; the driver folds one type per task.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: T.DataType = T.NullType()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                try:
                    record = json.loads(line)
                except ValueError:
                    continue
                if isinstance(record, dict):
                    kind = merge_json_types(kind, json_type(record))
        yield pa.RecordBatch.from_arrays([pa.array([kind.json()])], ["kind"])

    parts = spark.read.text(paths).mapInArrow(fold, "kind string").distinct().collect()
    out: T.DataType = T.NullType()
    for r in sorted(p["kind"] for p in parts):
        part = json.loads(r)
        out = merge_json_types(out, T.StructType.fromJson(part) if isinstance(part, dict) else T.NullType())
    return out if isinstance(out, T.StructType) else T.StructType([])


def json_type(value) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, list):
        kind: T.DataType = T.NullType()
        for v in value:
            kind = merge_json_types(kind, json_type(v))
        return T.ArrayType(kind)
    return T.StructType([T.StructField(k, json_type(v)) for k, v in value.items()])


def _encoding(name: str, spark: SparkSession | None = None) -> str:
    if name not in _ENCODINGS:
        raise ContractError(f"unknown encoding {name}")
    if name == "windows-1252" and spark is not None:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else readers know seven charsets only
    return _ENCODINGS[name]


def _refuse_undecoded(paths: list[str]) -> None:
    for p in paths:
        if p.endswith((".xz", ".br", ".sz", ".lz4", ".zst")):
            raise ContractError(f"{p}: decode it with read_decoded_lines first")


# -- formats that Spark does not read -------------------------------------------------------------


def decoded(data: bytes, path: str) -> bytes:
    """File contents after the byte transform that the extension names."""
    if path.endswith(".gz"):
        return gzip.decompress(data)
    if path.endswith(".bz2"):
        return bz2.decompress(data)
    if path.endswith(".xz"):
        return lzma.decompress(data)
    if path.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
    if path.endswith((".lz4", ".br")):
        return pa.input_stream(io.BytesIO(data), compression="lz4" if path.endswith(".lz4") else "brotli").read()
    if path.endswith(".sz"):
        return _framed_snappy(data)
    return data


def _framed_snappy(data: bytes) -> bytes:
    """Chunks of Snappy's framing format."""
    out, at = [], 0
    while at < len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            out.append(_raw_snappy(body[4:]))
        elif kind == 1:
            out.append(body[4:])
        elif 2 <= kind < 0x80:
            raise SchemaError("unknown chunk in framed snappy")
    return b"".join(out)


def _raw_snappy(block: bytes) -> bytes:
    size, shift, at = 0, 0, 0
    while True:
        byte = block[at]
        size |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            break
    return pa.Codec("snappy").decompress(block, size, asbytes=True)


def read_decoded_lines(spark: SparkSession, paths: list[str], encoding: str = "utf8") -> DataFrame:
    """(path, value): the lines of files in any known compression, decoded in the tasks that read them."""
    name = _encoding(encoding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = decoded(data, path).decode(name).splitlines()
                for at in range(0, len(lines), 65536):
                    part = lines[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(part)], ["path", "value"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, value string")


def read_arrow_ipc(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Arrow IPC files or streams, told apart by their first bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                if data[:6] == b"ARROW1":
                    reader = pa.ipc.open_file(data)
                    found = (reader.get_batch(i) for i in range(reader.num_record_batches))
                else:
                    found = iter(pa.ipc.open_stream(data))
                for b in found:
                    yield b.select(want.names).cast(want)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, schema)


# -- Avro object containers


def _zigzag(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            return (n >> 1) ^ -(n & 1), at


def _avro_value(kind, data: bytes, at: int):
    if isinstance(kind, list):
        branch, at = _zigzag(data, at)
        return _avro_value(kind[branch], data, at)
    name = kind["type"] if isinstance(kind, dict) else kind
    if isinstance(name, (dict, list)):
        return _avro_value(name, data, at)
    if name == "null":
        return None, at
    if name == "boolean":
        return data[at] == 1, at + 1
    if name in ("int", "long"):
        return _zigzag(data, at)
    if name in ("float", "double"):
        form, size = ("<f", 4) if name == "float" else ("<d", 8)
        return struct.unpack_from(form, data, at)[0], at + size
    if name in ("string", "bytes"):
        size, at = _zigzag(data, at)
        raw = data[at : at + size]
        return (raw.decode() if name == "string" else raw), at + size
    if name == "fixed":
        return data[at : at + kind["size"]], at + kind["size"]
    if name == "enum":
        index, at = _zigzag(data, at)
        return kind["symbols"][index], at
    if name == "record":
        out = {}
        for f in kind["fields"]:
            out[f["name"]], at = _avro_value(f["type"], data, at)
        return out, at
    if name in ("array", "map"):
        items: list = []
        while True:
            count, at = _zigzag(data, at)
            if count == 0:
                return (items if name == "array" else dict(items)), at
            if count < 0:
                _, at = _zigzag(data, at)
            for _ in range(abs(count)):
                if name == "map":
                    key, at = _avro_value("string", data, at)
                    value, at = _avro_value(kind["values"], data, at)
                    items.append((key, value))
                else:
                    value, at = _avro_value(kind["items"], data, at)
                    items.append(value)
    raise SchemaError(f"unknown Avro type {name}")


def avro_records(data: bytes) -> Iterator[dict]:
    """Records of one object container file (codecs null, deflate, snappy, zstandard, bzip2, xz)."""
    if data[:4] != b"Obj\x01":
        raise SchemaError("not an Avro object container")
    meta, at = _avro_value({"type": "map", "values": "bytes"}, data, 4)
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    at += 16
    while at < len(data):
        count, at = _zigzag(data, at)
        size, at = _zigzag(data, at)
        block = data[at : at + size]
        at += size + 16
        if codec == "deflate":
            block = zlib.decompress(block, -15)
        elif codec == "snappy":
            block = _raw_snappy(block[:-4])
        elif codec in ("zstandard", "bzip2", "xz"):
            block = decoded(block, {"zstandard": ".zst", "bzip2": ".bz2", "xz": ".xz"}[codec])
        elif codec != "null":
            raise SchemaError(f"unknown Avro codec {codec}")
        where = 0
        for _ in range(count):
            record, where = _avro_value(schema, block, where)
            yield record


def read_avro(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Avro object containers under a Spark schema; one task decodes a file, block by block."""
    return _whole_files(spark, paths, schema, avro_records)


def _whole_files(spark: SparkSession, paths: list[str], schema: T.StructType, records) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = records(data)
                while part := list(itertools.islice(found, 8192)):
                    yield pa.RecordBatch.from_pylist(part, schema=want)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, schema)


# -- length-delimited protocol buffers

#: Wire forms by declared type; repeated fields take ``repeated:`` before the type.
_VARINTS = frozenset("int32 int64 uint32 uint64 sint32 sint64 bool enum".split())
_FIXED = {"fixed32": "<I", "sfixed32": "<i", "float": "<f", "fixed64": "<Q", "sfixed64": "<q", "double": "<d"}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            return n, at


def _scalar(kind: str, raw: int) -> int | bool:
    if kind == "bool":
        return bool(raw)
    if kind.startswith("sint"):
        return (raw >> 1) ^ -(raw & 1)
    if kind in ("int32", "int64", "enum") and raw >= 1 << 63:
        return raw - (1 << 64)
    return raw


def protobuf_message(data: bytes, fields: dict[int, tuple]) -> dict:
    """One message by its fields: number to (name, type[, nested fields]); unknown fields are skipped."""
    out: dict = {f[0]: [] for f in fields.values() if f[1].startswith("repeated:")}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            raw, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            raw, at = data[at : at + size], at + size
            if len(raw) < size:
                raise SchemaError("a message ends early")
        else:
            raise SchemaError(f"unknown wire type {wire}")
        if number not in fields:
            continue
        name, kind, *nested = fields[number]
        many = kind.startswith("repeated:")
        kind = kind.removeprefix("repeated:")
        if wire == 2 and many and (kind in _VARINTS or kind in _FIXED):
            where = 0
            while where < len(raw):  # packed
                if kind in _VARINTS:
                    value, where = _varint(raw, where)
                    out[name].append(_scalar(kind, value))
                else:
                    out[name].append(struct.unpack_from(_FIXED[kind], raw, where)[0])
                    where += struct.calcsize(_FIXED[kind])
            continue
        if kind in _VARINTS:
            value = _scalar(kind, raw)
        elif kind in _FIXED:
            value = struct.unpack(_FIXED[kind], raw)[0]
        elif kind == "string":
            value = raw.decode()
        elif kind == "bytes":
            value = raw
        else:
            value = protobuf_message(raw, nested[0])
        if many:
            out[name].append(value)
        else:
            out[name] = value
    return out


def read_protobuf(spark: SparkSession, paths: list[str], fields: dict[int, tuple], schema: T.StructType) -> DataFrame:
    """Files of length-delimited messages, of which only the schema's fields are kept."""
    wanted = {n: f for n, f in fields.items() if f[0] in schema.names}

    def records(data: bytes) -> Iterator[dict]:
        at = 0
        while at < len(data):
            size, at = _varint(data, at)
            yield protobuf_message(data[at : at + size], wanted)
            at += size

    return _whole_files(spark, paths, schema, records)
