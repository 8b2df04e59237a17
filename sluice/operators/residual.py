"""Values that a schema has no place for, kept in one nullable text column as a JSON envelope.

The envelope is ``{"v":1,"fields":{pointer:{"arrow_type","encoding","value"}}}`` with pointers in order, so
equal residuals are equal texts.  All of it is built by JVM expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import ContractError

VARIANT_COLUMN = "_variant"
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def pointer(*segments: str) -> str:
    """A JSON pointer."""
    return "".join("/" + s.replace("~", "~0").replace("/", "~1") for s in segments)


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    inner = F.to_json(F.struct(text.alias("x")))
    return F.substring(inner, F.lit(6), F.char_length(inner) - 6)


def encoded(value: Column, kind: T.DataType) -> tuple[str, Column]:
    """(encoding, JSON text) of a value; numbers that JSON readers may round are texts."""
    if isinstance(kind, T.BooleanType):
        return "json", value.cast("string")
    if isinstance(kind, _NUMBERS):
        return "decimal_text", F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    if isinstance(kind, T.BinaryType):
        return "base64", F.concat(F.lit('"'), F.regexp_replace(F.base64(value), "[\r\n]", ""), F.lit('"'))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return "json", F.to_json(value)
    return "text", _quoted(value.cast("string"))


def envelope(fields: Sequence[tuple[str, Column, T.DataType]]) -> Column:
    """The envelope of the fields whose value is there; null if none is."""
    parts = []
    for path, value, kind in sorted(fields, key=lambda f: f[0]):
        encoding, text = encoded(value, kind)
        head = _quoted(F.lit(path))
        body = F.concat(head, F.lit(f':{{"arrow_type":"{kind.simpleString()}","encoding":"{encoding}","value":'), text, F.lit("}"))
        parts.append(F.when(value.isNotNull(), body))
    if not parts:
        return F.lit(None).cast("string")
    every = F.array_compact(F.array(*parts))
    return F.when(F.size(every) > 0, F.concat(F.lit('{"v":1,"fields":{'), F.array_join(every, ","), F.lit("}}")))


def capture(df: DataFrame, known: Sequence[str], column: str = VARIANT_COLUMN, unfit: dict[str, T.DataType] | None = None) -> DataFrame:
    """Move the columns of ``df`` that are not ``known`` into the variant column.

    ``unfit`` names known text columns with the types they should have: texts that do not parse are captured
    under the column's pointer, and the column becomes typed, null there.
    """
    if column in df.columns:
        raise ContractError(f"{column} is there already")
    kinds = {f.name: f.dataType for f in df.schema}
    fields = [(pointer(c), F.col(f"`{c}`"), kinds[c]) for c in df.columns if c not in known]
    kept = []
    for c in known:
        value = F.col(f"`{c}`")
        want = (unfit or {}).get(c)
        if want is not None and kinds[c] != want:
            fields.append((pointer(c), F.when(value.try_cast(want).isNull(), value), kinds[c]))
            value = value.try_cast(want).alias(c)
        kept.append(value)
    return df.select(*kept, envelope(fields).alias(column))


def residual_value(column: str, path: str, kind: str) -> Column:
    """The value at a pointer of the envelope, as ``kind``; null where it is absent or does not parse."""
    fields = F.from_json(F.get_json_object(column, "$.fields"), "map<string,struct<arrow_type:string,encoding:string,value:string>>")
    value = F.try_element_at(fields, F.lit(path))["value"]
    return value.try_cast(kind)


def without_path(column: str, path: str) -> Column:
    """The envelope without a pointer; null if nothing is left."""
    fields = F.from_json(F.get_json_object(column, "$.fields"), "map<string,string>")
    rest = F.map_filter(fields, lambda k, _: k != path)
    keys = F.array_sort(F.map_keys(rest))
    parts = F.transform(keys, lambda k: F.concat(_quoted(k), F.lit(":"), F.element_at(rest, k)))
    return F.when(F.size(keys) > 0, F.concat(F.lit('{"v":1,"fields":{'), F.array_join(parts, ","), F.lit("}}")))


def promote(df: DataFrame, path: str, name: str, kind: str, column: str = VARIANT_COLUMN) -> DataFrame:
    """Make a residual path a real column and take it out of the envelope where it parses."""
    if name in df.columns:
        raise ContractError(f"{name} is there already")
    value = residual_value(column, path, kind)
    rest = F.when(value.isNotNull(), without_path(column, path)).otherwise(F.col(column))
    return df.withColumns({name: value, column: rest})


def promotion_candidates(df: DataFrame, column: str = VARIANT_COLUMN) -> DataFrame:
    """Residual paths with their rows and types: what a promotion could propose."""
    fields = F.from_json(F.get_json_object(column, "$.fields"), "map<string,struct<arrow_type:string>>")
    rows = df.where(F.col(column).isNotNull()).select(F.explode(fields).alias("path", "f"))
    return rows.groupBy("path", F.col("f.arrow_type").alias("type")).agg(F.count(F.lit(1)).alias("rows"))
