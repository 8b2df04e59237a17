"""Schemas: reconciling types, joining the schemas of many files, names, fingerprints, type checks."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ContractError, SchemaError
from sluice.plans.resource import DestinationSheet

# fixed values: decimal digits that hold every value of a whole-number type
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class TypePolicy:
    coerce_types: bool = True
    preserve_decimal_exactness: bool = True
    preserve_timestamp_timezone: bool = True
    allow_lossy_mapping: bool = False


@dataclass(frozen=True)
class FieldDecision:
    """What becomes of one field: preserved, widened, coerced, lossy_allowed, lossy_rejected, unsupported, missing or extra."""

    name: str
    decision: str
    observed: str | None
    constraint: str | None
    allowance: str | None = None

    @property
    def refused(self) -> bool:
        return self.decision in ("lossy_rejected", "unsupported")


def widens(observed: T.DataType, constraint: T.DataType) -> bool:
    """Whether every value of one type is a value of the other."""
    a, b = _BITS.get(type(observed)), _BITS.get(type(constraint))
    if a and b:
        return a < b
    if a and isinstance(constraint, T.DecimalType):
        return constraint.precision >= DIGITS[observed.simpleString()] + constraint.scale
    if isinstance(observed, T.FloatType):
        return isinstance(constraint, T.DoubleType)
    return isinstance(observed, T.DateType) and isinstance(constraint, (T.TimestampType, T.TimestampNTZType))


def reconcile_type(observed: T.DataType, constraint: T.DataType, policy: TypePolicy = TypePolicy()) -> tuple[str, str | None]:
    """(decision, allowance that a refused decision would need)."""
    if observed == constraint:
        return "preserved", None
    if widens(observed, constraint):
        return "widened", None
    if isinstance(observed, T.StringType) and isinstance(constraint, (*_NUMBERS, *_TEMPORAL, T.BooleanType)):
        return ("coerced", None) if policy.coerce_types else ("lossy_rejected", "coerce_types")
    lossy = isinstance(observed, _NUMBERS) and isinstance(constraint, _NUMBERS)
    lossy |= isinstance(observed, (T.TimestampType, T.TimestampNTZType)) and isinstance(constraint, T.DateType)
    if lossy:
        return ("lossy_allowed", None) if policy.allow_lossy_mapping else ("lossy_rejected", "allow_lossy_mapping")
    return "unsupported", None


def reconcile(observed: T.StructType, constraint: T.StructType, policy: TypePolicy = TypePolicy()) -> list[FieldDecision]:
    """A decision per field of the constraint, then per field it does not know, in order."""
    seen = {f.name: f for f in observed}
    out = []
    for want in constraint:
        have = seen.pop(want.name, None)
        if have is None:
            out.append(FieldDecision(want.name, "missing", None, want.dataType.simpleString()))
            continue
        decision, allowance = reconcile_type(have.dataType, want.dataType, policy)
        out.append(FieldDecision(want.name, decision, have.dataType.simpleString(), want.dataType.simpleString(), allowance))
    return out + [FieldDecision(f.name, "extra", f.dataType.simpleString(), None) for f in seen.values()]


def unfit(value: Column, kind: T.DataType) -> Column:
    """Rows whose text is there but does not parse as ``kind``."""
    return value.isNotNull() & value.try_cast(kind).isNull()


def conform(df: DataFrame, constraint: T.StructType, policy: TypePolicy = TypePolicy()) -> tuple[DataFrame, list[FieldDecision]]:
    """``df`` in the types and order of the constraint, with the decisions; fields it does not know are left to capture.

    Coerced texts that do not parse become null here; ``unfit`` finds them for the contract.
    """
    decisions = reconcile(df.schema, constraint, policy)
    if refused := [d for d in decisions if d.refused]:
        raise SchemaError("; ".join(f"{d.name}: {d.observed} as {d.constraint} is {d.decision}" + (f", needs {d.allowance}" if d.allowance else "") for d in refused))
    by_name = {d.name: d for d in decisions}
    columns = []
    for f in constraint:
        d, value = by_name[f.name], F.col(f"`{f.name}`")
        if d.decision == "missing":
            if not f.nullable:
                raise SchemaError(f"{f.name} is missing and must not be null")
            value = F.lit(None).cast(f.dataType)
        elif d.decision == "coerced":
            value = value.try_cast(f.dataType)
        elif d.decision != "preserved":
            value = value.cast(f.dataType)
        columns.append(value.alias(f.name, metadata=f.metadata or {}))
    return df.select(*columns), decisions


# -- many files ------------------------------------------------------------------------------


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type of the two that holds both, if one does; null yields to any type."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType) or widens(a, b):
        return b
    if widens(b, a):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return join_structs([a, b])[0]
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = wider(a.elementType, b.elementType)
        return T.ArrayType(inner, a.containsNull or b.containsNull) if inner else None
    return None


def join_structs(schemas: Sequence[T.StructType]) -> tuple[T.StructType, list[tuple[int, str]]]:
    """The schema that covers all, and (index, field) of what does not fit it."""
    names = list(dict.fromkeys(f.name for s in schemas for f in s))
    fields, clashes = [], []
    for name in names:
        present = [(i, s[name]) for i, s in enumerate(schemas) if name in s.names]
        kind, nullable = present[0][1].dataType, len(present) < len(schemas)
        for i, f in present:
            nullable |= f.nullable
            joined = wider(kind, f.dataType)
            if joined is None:
                clashes.append((i, name))
            else:
                kind = joined
        fields.append(T.StructField(name, kind, nullable, present[0][1].metadata))
    return T.StructType(fields), clashes


def join_schemas(located: dict[str, T.StructType]) -> tuple[T.StructType, list[dict]]:
    """The joined schema over files in the order of their locations, and a verdict per file and field."""
    if not located:
        raise SchemaError("no schema to join")
    order = sorted(located)
    joined, clashes = join_structs([located[k] for k in order])
    bad = {(order[i], name) for i, name in clashes}
    verdicts = []
    for location in order:
        for f in joined:
            have = located[location][f.name].dataType if f.name in located[location].names else None
            verdict = "missing_null" if have is None else "incompatible" if (location, f.name) in bad else "preserved" if have == f.dataType else "widened"
            verdicts.append({"location": location, "field": f.name, "verdict": verdict})
    return joined, verdicts


def union_files(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows of many files under their joined schema: types widened, missing fields null."""
    joined, verdicts = join_schemas({k: df.schema for k, df in frames.items()})
    if bad := [v for v in verdicts if v["verdict"] == "incompatible"]:
        raise SchemaError("; ".join(f"{v['location']}: {v['field']} does not fit" for v in bad))
    parts = []
    for location in sorted(frames):
        df = frames[location]
        parts.append(df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in joined]))
    return reduce(DataFrame.unionByName, parts)


def merge_json_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a JSON field seen with two types.

    Null yields to any; whole and fractional numbers give double; a scalar beside a list gives the list; scalars
    that differ give string; objects merge by field; anything else is an error.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys([*a.names, *b.names]))
        return T.StructType([T.StructField(n, merge_json_types(a[n].dataType, b[n].dataType) if n in a.names and n in b.names else (a if n in a.names else b)[n].dataType) for n in names])
    if isinstance(a, T.ArrayType) or isinstance(b, T.ArrayType):
        if isinstance(a, T.StructType) or isinstance(b, T.StructType):
            raise SchemaError("an object beside a list")
        inner = [x.elementType if isinstance(x, T.ArrayType) else x for x in (a, b)]
        return T.ArrayType(merge_json_types(*inner))
    if isinstance(a, T.StructType) or isinstance(b, T.StructType):
        raise SchemaError("an object beside a scalar")
    if isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS):
        return T.DoubleType() if isinstance(a, T.DoubleType) or isinstance(b, T.DoubleType) else T.LongType()
    return T.StringType()


# -- names -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class NamePolicy:
    max_length: int | None = None
    allowed_pattern: str | None = None


def _snake(name: str) -> str:
    """Words in lower case, joined by single underscores; a word starts at a capital after a small letter or before one."""
    out: list[str] = []
    in_word = after_small = False
    for i, ch in enumerate(name):
        if not (ch.isalpha() or unicodedata.category(ch).startswith("N")):
            out.append("_")
            in_word = after_small = False
            continue
        small_next = i + 1 < len(name) and name[i + 1].islower()
        if ch.isupper() and in_word and (after_small or small_next):
            out.append("_")
        out.append(ch.lower())
        in_word, after_small = True, ch.islower() or unicodedata.category(ch).startswith("N")
    return re.sub(r"_+", "_", "".join(out)).strip("_")


def _short_hash(name: str) -> str:
    """The low 32 bits of the name's 64-bit FNV-1a hash."""
    # fixed values: the offset and the prime of that hash
    h, prime = 0xCBF29CE484222325, 0x100000001B3
    for byte in name.encode():
        h = (h ^ byte) * prime & 0xFFFFFFFFFFFFFFFF
    return f"{h & 0xFFFFFFFF:08x}"


def normalize_name(name: str, policy: NamePolicy = NamePolicy()) -> str:
    """A column name in lower snake case of ASCII letters and digits; ``field`` if nothing is left."""
    if policy.max_length is not None and policy.max_length < 10:
        raise ContractError("max_length must leave room for a hash")
    plain = re.sub(r"[^a-z0-9]+", "_", _snake(unicodedata.normalize("NFC", name))).strip("_") or "field"
    if policy.max_length is not None and len(plain) > policy.max_length:
        plain = plain[: policy.max_length - 9].rstrip("_") + "_" + _short_hash(name)
    if policy.allowed_pattern is not None and not re.search(policy.allowed_pattern, plain):
        raise ContractError(f"{plain!r}, from {name!r}, does not match {policy.allowed_pattern!r}; rename it")
    return plain


def normalize_columns(df: DataFrame, policy: NamePolicy = NamePolicy()) -> DataFrame:
    """Rename all columns, keep each one's first name as ``source_name``; two that fall together are an error."""
    new = [normalize_name(c, policy) for c in df.columns]
    if clash := {n for n in new if new.count(n) > 1}:
        raise ContractError(f"names fall together: {sorted(clash)}")
    meta = [{"source_name": f.name} | (f.metadata or {}) for f in df.schema]
    return df.select(*[F.col(f"`{old}`").alias(n, metadata=m) for old, n, m in zip(df.columns, new, meta)])


def fingerprint(schema: T.StructType) -> str:
    """SHA-256 of the schema's names, types, nullability and metadata, independent of key order."""
    return "sha256:" + hashlib.sha256(json.dumps(json.loads(schema.json()), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def check_destination(schema: T.StructType, sheet: DestinationSheet, allow_lossy: bool = False) -> None:
    """Refuse types that a destination does not take, and lossy ones without an allowance."""
    for f in schema:
        kind = f.dataType.typeName()
        if kind in sheet.unsupported:
            raise SchemaError(f"{f.name}: {kind} is unsupported there")
        if kind in sheet.lossy and not allow_lossy:
            raise SchemaError(f"{f.name}: {kind} is lossy there and needs an allowance")
