"""Scalar functions that resource queries may call, by the names of common SQL engines.

All are immutable: a result depends on the arguments alone, never on the session, the clock
or chance.  Every function is a composition of Spark built-ins, so calls stay in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.errors import AdmissionError

#: Functions of a session, the clock or chance.
REFUSED = frozenset(
    "random rand randn uuid shuffle now current_date current_time current_timestamp current_user session_user user "
    "localtimestamp current_timezone current_catalog current_database version monotonically_increasing_id spark_partition_id input_file_name".split()
)
_AGGREGATES = frozenset("count sum avg min max stddev variance array_agg string_agg first last median any_value bool_and bool_or count_if row_number rank lag lead".split())

_TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "integer": "int", "int": "int", "bigint": "bigint", "smallint": "smallint", "tinyint": "tinyint",
    "float32": "float", "float64": "double", "real": "float", "float": "float", "double": "double", "utf8": "string", "text": "string", "varchar": "string", "string": "string",
    "bool": "boolean", "boolean": "boolean", "date": "date", "date32": "date", "bytea": "binary", "binary": "binary", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
}


def type_name(name: str) -> str:
    """Spark's name of a type in a cast."""
    low = name.lower()
    if low in _TYPES:
        return _TYPES[low]
    if low.startswith(("decimal", "numeric")):
        return "decimal" + low[low.index("(") :] if "(" in low else "decimal(38,10)"
    if low.startswith(("array<", "map<", "struct<")):
        return low
    raise AdmissionError(f"unknown type {name}")


def _named(name: str) -> Callable[..., Column]:
    return lambda *a: F.call_function(name, *a)


#: name: (least arguments, most arguments, builder).
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {}
FAMILY: dict[str, str] = {}


def _add(family: str, spec: str, build: Callable[..., Column] | None = None) -> None:
    """``spec`` lists ``name/least[-most]``; without a builder the Spark function of that name is called."""
    for item in spec.split():
        name, _, arity = item.partition("/")
        least, _, most = arity.partition("-")
        FUNCTIONS[name] = (int(least), int(most or least), build or _named(name))
        FAMILY[name] = family


_MANY = 255
_literal = "__literal__"  # builders with this attribute take literal arguments as Python values


def _takes_literals(fn):
    setattr(fn, _literal, True)
    return fn


_add("math", "abs/1 ceil/1-2 floor/1-2 round/1-2 sqrt/1 cbrt/1 exp/1 ln/1 log2/1 log10/1 log1p/1 expm1/1 power/2 pow/2 signum/1 greatest/1-255 least/1-255 pmod/2 mod/2 "
     "sin/1 cos/1 tan/1 cot/1 asin/1 acos/1 atan/1 atan2/2 sinh/1 cosh/1 tanh/1 asinh/1 acosh/1 atanh/1 degrees/1 radians/1 factorial/1 hypot/2 isnan/1 nanvl/2 width_bucket/4 bround/1-2 rint/1")  # fmt: skip
_add("math", "log/1-2", lambda *a: F.log10(a[0]) if len(a) == 1 else F.call_function("log", *a))
_add("math", "sign/1", lambda a: F.signum(a))
_add("math", "iszero/1", lambda a: a == 0)
_add("math", "pi/0", lambda: F.call_function("pi"))
_add("math", "trunc/1-2", lambda a, n=None: _truncate(a, n))
_add("math", "gcd/2", lambda a, b: _gcd(a, b))
_add("math", "lcm/2", lambda a, b: F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(F.call_function("div", a, _gcd(a, b)) * b)))
_add("math", "div/2", lambda a, b: F.call_function("div", a, b))


def _truncate(a: Column, n: Column | None) -> Column:
    if n is None:
        return F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double")
    scale = F.pow(F.lit(10.0), n)
    return F.when(a < 0, F.ceil(a * scale)).otherwise(F.floor(a * scale)) / scale


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps over arrays; 92 suffice for 64-bit numbers, and the later ones are taken only where they are needed."""
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    state = F.array(F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y")))
    for n in (6, 18, 68):
        counts = F.sequence(F.lit(1), F.lit(n))
        state = F.transform(state, lambda s: F.when(s["y"] == 0, s).otherwise(F.aggregate(counts, s, step)))  # noqa: B023
    return state[0]["x"]


_add("string", "lower/1 upper/1 btrim/1-2 ltrim/1 rtrim/1 trim/1 replace/3 repeat/2 concat/1-255 split_part/3 lpad/2-3 rpad/2-3 translate/3 ascii/1 overlay/3-4 levenshtein/2 contains/2 "
     "substring/2-3 substr/2-3 concat_ws/1-255 soundex/1 find_in_set/2 substring_index/3")  # fmt: skip
_add("string", "starts_with/2 startswith/2", lambda a, b: F.call_function("startswith", a, b))
_add("string", "ends_with/2 endswith/2", lambda a, b: F.call_function("endswith", a, b))
_add("string", "length/1 char_length/1 character_length/1", lambda a: F.char_length(a))
_add("string", "chr/1", _named("chr"))
_add("string", "to_hex/1", lambda a: F.lower(F.hex(a)))
_add("string", "substr_index/3", _named("substring_index"))
_add("unicode", "reverse/1 initcap/1 octet_length/1 bit_length/1")
_add("unicode", "left/2", lambda a, n: F.when(n >= 0, F.left(a, n)).otherwise(F.substring(a, F.lit(1), F.greatest(F.char_length(a) + n, F.lit(0)))))
_add("unicode", "right/2", lambda a, n: F.when(n >= 0, F.right(a, n)).otherwise(F.substring(a, F.lit(1) - n, F.char_length(a))))
_add("unicode", "strpos/2 instr/2", lambda a, b: F.call_function("instr", a, b))
_add("unicode", "position/2", lambda a, b: F.call_function("instr", b, a))


@_takes_literals
def _string_to_array(a, sep, null=None):
    """Split at a text taken as it is; an empty separator gives the whole text, null each character."""
    if sep is None:
        out = F.split(a, F.lit("(?!^)(?!$)"))
    elif isinstance(sep, str):
        quoted = "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        out = F.split(a, F.lit(quoted)) if sep else F.array(a)
    else:
        out = F.split(a, F.concat(F.lit("\\Q"), sep, F.lit("\\E")))
    out = F.when(a == "", F.array().cast("array<string>")).when(a.isNotNull(), out)
    if null is not None:
        out = F.transform(out, lambda x: F.when(x != null, x))
    return out


_add("nested", "string_to_array/2-3 string_to_list/2-3", _string_to_array)
_add("nested", "array_distinct/1 array_union/2 array_intersect/2 array_except/2 array_remove/2 array_append/2 array_prepend/2 array_max/1 array_min/1 "
     "array_position/2 array_repeat/2 flatten/1 element_at/2 map_keys/1 map_values/1 map_entries/1 named_struct/2-255 arrays_zip/1-255 sequence/2-3 arrays_overlap/2 sort_array/1-2 array_compact/1")  # fmt: skip
_add("nested", "array_length/1 list_length/1 cardinality/1 array_size/1", lambda a: F.when(a.isNotNull(), F.size(a)))
_add("nested", "array_has/2 array_contains/2 list_contains/2 list_has/2", lambda a, b: F.array_contains(a, b))
_add("nested", "array_has_all/2 list_has_all/2", lambda a, b: F.size(F.array_except(b, a)) == 0)
_add("nested", "array_has_any/2 list_has_any/2", lambda a, b: F.arrays_overlap(a, b))
_add("nested", "array_concat/1-255 list_concat/1-255 array_cat/1-255", lambda *a: F.concat(*a))
_add("nested", "array_to_string/2-3 list_to_string/2-3 array_join/2-3", lambda a, sep, null=None: F.call_function("array_join", F.transform(a, lambda x: x.cast("string")), sep, *([null] if null is not None else [])))
_add("nested", "array_element/2 list_element/2", lambda a, i: F.try_element_at(a, i.cast("int")))
_add("nested", "array_slice/3 list_slice/3", lambda a, i, j: F.slice(a, i.cast("int"), F.greatest(F.lit(0), (j - i + 1)).cast("int")))
_add("nested", "array_sort/1 list_sort/1", lambda a: F.sort_array(a))
_add("nested", "array_reverse/1 list_reverse/1", lambda a: F.reverse(a))
_add("nested", "make_array/0-255 make_list/0-255", lambda *a: F.array(*a))
_add("nested", "struct/1-255", lambda *a: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(a)]))
_add("nested", "get_field/2", _takes_literals(lambda a, name: a[name]))
_add("nested", "map_extract/2", lambda m, k: F.when(F.map_contains_key(m, k), F.array(F.try_element_at(m, k))).otherwise(F.array()))
_add("nested", "empty/1", lambda a: F.size(a) == 0)

_add("conditional", "nullif/2 coalesce/1-255 ifnull/2 nvl/2 nvl2/3 isnull/1 isnotnull/1 zeroifnull/1 nullifzero/1")
_add("conditional", "if/3", lambda c, a, b: F.when(c, a).otherwise(b))


@_takes_literals
def _encode(a, form):
    built = {"hex": lambda: F.lower(F.hex(a)), "base64": lambda: F.regexp_replace(F.base64(a.cast("binary")), "[\r\n=]", "")}.get(str(form).lower())
    if not built:
        raise AdmissionError(f"no encoding {form}")
    return built()


@_takes_literals
def _decode(a, form):
    built = {"hex": lambda: F.unhex(a), "base64": lambda: F.unbase64(a)}.get(str(form).lower())
    if not built:
        raise AdmissionError(f"no encoding {form}")
    return built()


_add("encoding", "encode/2", _encode)
_add("encoding", "decode/2", _decode)
_add("encoding", "hex/1 unhex/1 base64/1 unbase64/1")


@_takes_literals
def _date_part(part, a):
    part = str(part).lower()
    if part == "epoch":
        return F.unix_micros(a.cast("timestamp")) / 1e6
    if part in ("millisecond", "milliseconds", "microsecond", "microseconds"):
        micros = F.pmod(F.unix_micros(a.cast("timestamp")), F.lit(60_000_000))
        return (F.call_function("div", micros, F.lit(1000)) if part.startswith("milli") else micros).cast("int")
    name = {"dow": "DAYOFWEEK", "doy": "DAYOFYEAR", "isodow": "DAYOFWEEK_ISO"}.get(part, part.upper())
    if name not in ("YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND", "DAYOFWEEK", "DAYOFYEAR", "DAYOFWEEK_ISO"):
        raise AdmissionError(f"no date part {part}")
    out = F.date_part(F.lit(name), a)
    return out - 1 if part == "dow" else F.floor(out).cast("int") if part == "second" else out


@_takes_literals
def _date_bin(step, a, origin=None):
    """The start of the step, counted from the origin (1970 if none), that a time lies in."""
    amount, unit = str(step).split()[:2]
    micros = int(amount) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[unit[0].lower()] * 1_000_000
    at = F.unix_micros(a.cast("timestamp"))
    base = F.lit(0) if origin is None else F.unix_micros((F.lit(origin) if isinstance(origin, str) else origin).cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at - base, F.lit(micros)))


_add("datetime", "date_part/2 datepart/2", _date_part)
_add("datetime", "date_bin/2-3", _date_bin)
_add("datetime", "date_trunc/2", lambda unit, a: F.call_function("date_trunc", unit, a))
_add("datetime", "datetrunc/2", lambda unit, a: F.call_function("date_trunc", unit, a))
_add("datetime", "to_timestamp/1-2 to_date/1-2 make_date/3 last_day/1 date_add/2 date_sub/2 datediff/2 add_months/2 unix_seconds/1 unix_millis/1 unix_micros/1 year/1 month/1 day/1 hour/1 minute/1 second/1 quarter/1")
_add("datetime", "to_timestamp_seconds/1 from_unixtime/1", lambda a: F.timestamp_seconds(a))
_add("datetime", "to_timestamp_millis/1", lambda a: F.timestamp_millis(a))
_add("datetime", "to_timestamp_micros/1", lambda a: F.timestamp_micros(a))
_add("datetime", "to_unixtime/1", lambda a: F.unix_seconds(a.cast("timestamp")))
_add("datetime", "to_char/2 date_format/2", lambda a, f: F.call_function("date_format", a, f))

_add("crypto", "md5/1", lambda a: F.md5(a.cast("binary")))
_add("crypto", "sha1/1 crc32/1 xxhash64/1-255")
for _bits in (224, 256, 384, 512):
    _add("crypto", f"sha{_bits}/1", lambda a, n=_bits: F.unhex(F.sha2(a.cast("binary"), n)))


@_takes_literals
def _digest(a, form):
    form = str(form).lower()
    if form == "md5":
        return F.unhex(F.md5(a.cast("binary")))
    if form in ("sha224", "sha256", "sha384", "sha512"):
        return F.unhex(F.sha2(a.cast("binary"), int(form[3:])))
    raise AdmissionError(f"no digest {form}")


_add("crypto", "digest/2", _digest)
_add("crypto", "sha2/2", _takes_literals(lambda a, n: F.sha2(a.cast("binary"), int(n))))

_FLAGS = frozenset("imsxgU")


def _flagged(pattern, flags):
    if flags is None:
        return pattern if isinstance(pattern, Column) else F.lit(pattern)
    if not isinstance(flags, str) or set(flags) - _FLAGS:
        raise AdmissionError(f"no regular expression flags {flags}")
    inline = "".join(f for f in flags if f in "imsx")
    base = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return F.concat(F.lit(f"(?{inline})"), base) if inline else base


@_takes_literals
def _regexp_replace(a, pattern, to, flags=None):
    """Replaces the first match, or all with flag g; groups are written \\1 or ${1}."""
    to = to if isinstance(to, Column) else F.lit(to)
    to = F.regexp_replace(F.regexp_replace(to, r"\\(\d)", r"\$$1"), r"\$\{(\d+)\}", r"\$$1")
    pattern = _flagged(pattern, flags)
    if isinstance(flags, str) and "g" in flags:
        return F.regexp_replace(a, pattern, to)
    start = F.regexp_instr(a, pattern)
    found = F.regexp_substr(a, pattern)
    rest = F.substring(a, start + F.char_length(found), F.char_length(a))
    return F.when(a.isNull(), None).when(start == 0, a).otherwise(F.concat(F.substring(a, F.lit(1), start - 1), F.regexp_replace(found, pattern, to), rest))


_add("regex", "regexp_like/2-3", _takes_literals(lambda a, p, flags=None: F.regexp_like(a, _flagged(p, flags))))
_add("regex", "regexp_replace/3-4", _regexp_replace)
_add("regex", "regexp_count/2", lambda a, p: F.regexp_count(a, p))
_add("regex", "regexp_instr/2", lambda a, p: F.regexp_instr(a, p))
_add("regex", "regexp_extract/2-3 regexp_substr/2 regexp_extract_all/2-3")
_add("regex", "regexp_match/2-3", _takes_literals(lambda a, p, flags=None: _match(a, _flagged(p, flags), p)))

_add("json", "get_json_object/2 json_array_length/1 json_object_keys/1")


def _match(a: Column, pattern: Column, text) -> Column:
    """Groups of the first match (the whole match if there are none), null without one."""
    import re

    if not isinstance(text, str):
        raise AdmissionError("regexp_match needs a literal pattern")
    groups = re.compile(text).groups
    parts = [F.regexp_extract_all(a, pattern, F.lit(i))[0] for i in (range(1, groups + 1) if groups else [0])]
    return F.when(F.regexp_like(a, pattern), F.array(*parts))


def call(name: str, columns: list[Column], trees: list[tuple]) -> Column:
    """The column that a call of an admitted function means."""
    if name in REFUSED:
        raise AdmissionError(f"{name} is not immutable")
    if name in _AGGREGATES:
        raise AdmissionError(f"aggregate {name} is not a scalar function")
    if name not in FUNCTIONS:
        raise AdmissionError(f"function {name} is not admitted")
    least, most, build = FUNCTIONS[name]
    if not least <= len(columns) <= most:
        raise AdmissionError(f"{name} takes {least} to {most} arguments, not {len(columns)}")
    if getattr(build, _literal, False):
        columns = [t[1] if t[0] == "lit" else c for c, t in zip(columns, trees)]
        columns[0] = columns[0] if isinstance(columns[0], Column) or name in ("date_part", "datepart", "date_bin") else F.lit(columns[0])
        if name in ("date_part", "datepart", "date_bin") and trees[0][0] == "interval":
            columns[0] = trees[0][1]
        if name in ("date_part", "datepart", "date_bin") and not isinstance(columns[1], Column):
            columns[1] = F.lit(columns[1])
    return build(*columns)
