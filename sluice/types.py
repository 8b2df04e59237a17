"""Declared types by name, what Spark stores them as, and semantic types that ride on fields.

Names are ``int64``, ``timestamp(us, UTC)``, ``list<...>``, ``struct<a: utf8>``, ``map<k, v>``, ``decimal128(p, s)`` and
the like.  Types that Spark lacks go into the next wider one, and what they were is kept in metadata.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from sluice.errors import SchemaError

_SIMPLE: dict[str, tuple[T.DataType, dict]] = {
    "null": (T.NullType(), {}),
    "boolean": (T.BooleanType(), {}),
    "bool": (T.BooleanType(), {}),
    "int8": (T.ByteType(), {}),
    "int16": (T.ShortType(), {}),
    "int32": (T.IntegerType(), {}),
    "int64": (T.LongType(), {}),
    "uint8": (T.ShortType(), {"declared": "uint8", "min": "0", "max": "255"}),
    "uint16": (T.IntegerType(), {"declared": "uint16", "min": "0", "max": "65535"}),
    "uint32": (T.LongType(), {"declared": "uint32", "min": "0", "max": "4294967295"}),
    "uint64": (T.DecimalType(20, 0), {"declared": "uint64"}),
    "float16": (T.FloatType(), {"declared": "float16"}),
    "float32": (T.FloatType(), {}),
    "float64": (T.DoubleType(), {}),
    "utf8": (T.StringType(), {}),
    "large_utf8": (T.StringType(), {}),
    "utf8_view": (T.StringType(), {}),
    "binary": (T.BinaryType(), {}),
    "large_binary": (T.BinaryType(), {}),
    "binary_view": (T.BinaryType(), {}),
    "date32": (T.DateType(), {}),
    "date64": (T.DateType(), {"declared": "date64"}),
}
_UNITS = {"s": "s", "second": "s", "seconds": "s", "ms": "ms", "millisecond": "ms", "milliseconds": "ms", "us": "us", "microsecond": "us", "microseconds": "us", "ns": "ns", "nanosecond": "ns", "nanoseconds": "ns"}


def _parts(body: str) -> list[str]:
    """The text cut at its top-level commas."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch in "<(") - (ch in ">)")
        if depth < 0:
            raise SchemaError(f"unbalanced type {body!r}")
        if ch == "," and not depth:
            out.append(body[last:i].strip())
            last = i + 1
    if depth:
        raise SchemaError(f"unbalanced type {body!r}")
    return [*out, body[last:].strip()]


def _unit(text: str) -> str:
    if text.lower() not in _UNITS:
        raise SchemaError(f"unknown time unit {text!r}")
    return _UNITS[text.lower()]


def parse_type(text: str) -> tuple[T.DataType, dict]:
    """(Spark type, metadata that says what it stands for)."""
    text = text.strip()
    if text.lower() in _SIMPLE:
        return _SIMPLE[text.lower()]
    m = re.fullmatch(r"([A-Za-z_][A-Za-z0-9_]*)\s*(?:\((.*)\)|<(.*)>)", text, re.S)
    if not m:
        raise SchemaError(f"unknown type {text!r}")
    name, angled = m[1].lower(), m[3] is not None
    args = _parts(m[3] if angled else m[2])
    if angled:
        return _nested(name, args, text)
    if name in ("decimal", "decimal32", "decimal64", "decimal128", "decimal256"):
        most = {"decimal32": 9, "decimal64": 18, "decimal256": 76}.get(name, 38)
        if len(args) != 2 or not args[0].isdigit() or not re.fullmatch(r"-?\d+", args[1]):
            raise SchemaError(f"{text} needs precision and scale")
        precision, scale = int(args[0]), int(args[1])
        if not 1 <= precision <= most or abs(scale) > most:
            raise SchemaError(f"{text} is out of bounds")
        if precision > 38 or not 0 <= scale <= precision:
            return T.StringType(), {"declared": text}
        return T.DecimalType(precision, scale), {}
    if name == "timestamp" and 1 <= len(args) <= 2:
        unit, zone = _unit(args[0]), args[1].strip("'\"") if len(args) == 2 else None
        meta = {"timezone": zone} if zone else {}
        if unit == "ns":
            return T.LongType(), {"declared": text, **meta}
        return (T.TimestampType() if zone else T.TimestampNTZType()), meta
    if name == "date" and len(args) == 1 and args[0].lower() in ("day", "days", "d", "ms", "millisecond", "milliseconds"):
        return T.DateType(), {} if args[0].lower().startswith("d") else {"declared": text}
    if name in ("time", "time32", "time64") and len(args) == 1:
        unit = _unit(args[0])
        if (name == "time32" and unit not in ("s", "ms")) or (name == "time64" and unit not in ("us", "ns")):
            raise SchemaError(f"unknown type {text!r}")
        return (T.LongType(), {"declared": text}) if unit == "ns" else (T.TimeType(6), {})
    if name == "duration" and len(args) == 1:
        return (T.LongType(), {"declared": text}) if _unit(args[0]) == "ns" else (T.DayTimeIntervalType(), {})
    if name == "interval" and len(args) == 1 and args[0].lower() in ("year_month", "day_time", "month_day_nano"):
        kind = args[0].lower()
        if kind == "month_day_nano":
            return T.StructType.fromDDL("months int, days int, nanos bigint"), {"declared": text}
        return (T.YearMonthIntervalType() if kind == "year_month" else T.DayTimeIntervalType()), {}
    if name == "fixed_size_binary" and len(args) == 1 and args[0].isdigit():
        return T.BinaryType(), {"declared": text}
    raise SchemaError(f"unknown type {text!r}")


def _nested(name: str, args: list[str], text: str) -> tuple[T.DataType, dict]:
    if name in ("list", "large_list", "list_view") and len(args) == 1:
        return T.ArrayType(parse_type(args[0])[0]), {}
    if name == "fixed_size_list" and len(args) == 2 and args[1].isdigit():
        return T.ArrayType(parse_type(args[0])[0]), {"declared": text}
    if name == "map" and len(args) == 2:
        return T.MapType(parse_type(args[0])[0], parse_type(args[1])[0]), {}
    if name == "dictionary" and len(args) == 2:
        return parse_type(args[1])
    if name == "union":
        return T.VariantType(), {"declared": text}
    if name == "struct":
        fields = []
        for arg in args:
            field, colon, kind = arg.partition(":")
            if not colon or not field.strip():
                raise SchemaError(f"struct field {arg!r} needs a name and a type")
            fields.append(T.StructField(field.strip(), *parse_type(kind)[:1]))
        if len({f.name for f in fields}) < len(fields):
            raise SchemaError(f"{text} repeats a field")
        return T.StructType(fields), {}
    raise SchemaError(f"unknown type {text!r}")


def declared_schema(fields: dict[str, str], required: tuple[str, ...] = ()) -> T.StructType:
    """A schema from declared types by field name."""
    out = []
    for name, text in fields.items():
        kind, meta = parse_type(text)
        out.append(T.StructField(name, kind, name not in required, meta or None))
    return T.StructType(out)


# -- semantic types --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Semantic:
    """What a field's values mean: a versioned name, the types it fits, a pattern, a class of privacy."""

    reference: str
    types: tuple[str, ...] = ()
    pattern: str | None = None
    privacy: str = "public"


_KNOWN: dict[str, Semantic] = {}


def register_semantic(semantic: Semantic) -> None:
    if not re.fullmatch(r"[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*@[1-9]\d*", semantic.reference):
        raise SchemaError(f"{semantic.reference} is not namespace.name@version")
    if _KNOWN.setdefault(semantic.reference, semantic) != semantic:
        raise SchemaError(f"{semantic.reference} means something else already")


for _s in (
    Semantic("core.variant@1", ("string",)),
    Semantic("core.email@1", ("string",), r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "pii"),
    Semantic("core.json_text@1", ("string",)),
    Semantic("core.numeric_text@1", ("string",), r"^[+-]?\d+(\.\d+)?$"),
    Semantic("core.object_id@1", ("string", "binary"), r"^[0-9a-f]{24}$"),
    Semantic("core.rate@1", ("double", "float", "decimal")),
):
    register_semantic(_s)


def with_semantics(schema: T.StructType, semantics: dict[str, str]) -> T.StructType:
    """The schema with references in field metadata; unknown references, fields and unfit types are errors."""
    if missing := set(semantics) - set(schema.names):
        raise SchemaError(f"semantics of unknown fields {sorted(missing)}")
    fields = []
    for f in schema:
        if f.name not in semantics:
            fields.append(f)
            continue
        s = _KNOWN.get(semantics[f.name])
        if s is None:
            raise SchemaError(f"unknown semantic {semantics[f.name]}")
        if s.types and f.dataType.typeName() not in s.types:
            raise SchemaError(f"{f.name}: {s.reference} does not fit {f.dataType.simpleString()}")
        fields.append(T.StructField(f.name, f.dataType, f.nullable, {**(f.metadata or {}), "semantic": s.reference, "privacy": s.privacy}))
    return T.StructType(fields)


def semantic_rules(schema: T.StructType) -> list:
    """Contract rules that the fields' semantics imply, and for personal data a redaction."""
    from sluice.operators.contract import Regex

    return [Regex(f"{f.name}_{_KNOWN[m].reference}", f.name, _KNOWN[m].pattern) for f in schema if (m := (f.metadata or {}).get("semantic")) and _KNOWN[m].pattern]


def redactions(schema: T.StructType) -> dict[str, str]:
    """Evidence of personal data is hashed; everything else is preserved."""
    return {f.name: "hash" for f in schema if (f.metadata or {}).get("privacy") == "pii"}
