"""Scalar expressions: declarative comparisons, calls, operators and their admission.

Everything lowers to a Spark ``Column``, so that Catalyst folds, prunes and pushes it down.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import AdmissionError, ContractError
from sluice.functions import library
from sluice.functions.sqltext import columns_of, parse_scalar

# -- declarative comparisons: "column op literal" ------------------------------------------

_COMPARE = re.compile(r"\s*(?P<column>[A-Za-z_][A-Za-z0-9_.]*)\s*(?P<op><=|>=|!=|=|<|>)\s*(?P<literal>.+?)\s*", re.S)
_INTEGER = re.compile(r"[+-]?\d+")
_QUOTED = re.compile(r"'((?:[^']|'')*)'|\"((?:[^\"]|\"\")*)\"", re.S)

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
REVERSED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def parse_literal(text: str):
    """null, true, false, an integer, a finite float or a quoted string."""
    low = text.lower()
    if low in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[low]
    if _INTEGER.fullmatch(text):
        value = int(text)
        if not -(2**63) <= value < 2**64:
            raise AdmissionError(f"integer out of range: {text}")
        return value
    if m := _QUOTED.fullmatch(text):
        return m[1].replace("''", "'") if m[1] is not None else m[2].replace('""', '"')
    try:
        value = float(text)
    except ValueError:
        raise AdmissionError(f"not a literal: {text}") from None
    if not math.isfinite(value):
        raise AdmissionError(f"not a finite number: {text}")
    return value


def parse_comparison(text: str) -> tuple[str, str, object]:
    """(column, operator, literal) of a declarative comparison."""
    if not (m := _COMPARE.fullmatch(text)):
        raise AdmissionError(f"not a comparison of a column with a literal: {text}")
    return m["column"], m["op"], parse_literal(m["literal"])


def comparison(text: str) -> Column:
    column, op, value = parse_comparison(text)
    return COMPARISONS[op](F.col(column), F.lit(value))


#: Calls of declarative rules; null passes none of them as a filter (three-valued logic).
CALLS: dict[str, Callable[..., Column]] = {
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "and": lambda *xs: _fold(lambda a, b: a & b, xs),
    "or": lambda *xs: _fold(lambda a, b: a | b, xs),
    "not": lambda a: ~a,
    "is_null": lambda a: a.isNull(),
    "is_not_null": lambda a: a.isNotNull(),
}


def _fold(op, xs: Sequence[Column]) -> Column:
    if not xs:
        raise AdmissionError("and/or need an operand")
    out = xs[0]
    for x in xs[1:]:
        out = op(out, x)
    return out


def declared(tree) -> Column:
    """Lower ``{"call": name, "args": [...]}``, ``{"col": name}`` or a bare literal."""
    if isinstance(tree, dict) and "col" in tree:
        return F.col(tree["col"])
    if isinstance(tree, dict) and "call" in tree:
        if tree["call"] not in CALLS:
            raise AdmissionError(f"unknown call: {tree['call']}")
        return CALLS[tree["call"]](*map(declared, tree.get("args", ())))
    if tree is None or isinstance(tree, (bool, int, float, str)):
        return F.lit(tree)
    raise AdmissionError(f"not an expression: {tree!r}")


# -- operators of analysed expressions ------------------------------------------------------


def _integers(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


UNARY: dict[str, Callable[[Column], Column]] = {
    "not": lambda a: ~a,
    "negative": lambda a: -a,
    "is_null": lambda a: a.isNull(),
    "is_not_null": lambda a: a.isNotNull(),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = COMPARISONS | {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "div": _integers,  # whole-number division, toward zero
    "%": lambda a, b: a % b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "is distinct from": lambda a, b: ~a.eqNullSafe(b),
    "is not distinct from": lambda a, b: a.eqNullSafe(b),
    "~": lambda a, b: F.regexp_like(a, b),
    "~*": lambda a, b: F.regexp_like(a, F.concat(F.lit("(?i)"), b)),
    "!~": lambda a, b: ~F.regexp_like(a, b),
    "!~*": lambda a, b: ~F.regexp_like(a, F.concat(F.lit("(?i)"), b)),
    "like": lambda a, b: F.like(a, b),
    "ilike": lambda a, b: F.ilike(a, b),
    "not like": lambda a, b: ~F.like(a, b),
    "not ilike": lambda a, b: ~F.ilike(a, b),
    "&": lambda a, b: a.bitwiseAND(b),
    "|": lambda a, b: a.bitwiseOR(b),
    "^": lambda a, b: a.bitwiseXOR(b),
    "<<": lambda a, b: F.call_function("shiftleft", a, b),
    ">>": lambda a, b: F.call_function("shiftright", a, b),
    "||": lambda a, b: F.concat(a, b),
    "@>": lambda a, b: F.size(F.array_except(b, a)) == 0,
    "<@": lambda a, b: F.size(F.array_except(a, b)) == 0,
}


def unary(op: str, a: Column) -> Column:
    return UNARY[op](a)


def binary(op: str, a: Column, b: Column, *, whole: bool = False) -> Column:
    """Apply a binary operator; ``whole`` makes ``/`` the division of integers."""
    return BINARY["div" if op == "/" and whole else op](a, b)


def cast(value: Column, to: str, mode: str = "explicit") -> Column:
    """implicit and explicit casts fail on bad input; try gives null."""
    if mode not in ("implicit", "explicit", "try"):
        raise AdmissionError(f"unknown cast mode: {mode}")
    return value.try_cast(to) if mode == "try" else value.cast(to)


# -- analysed expressions --------------------------------------------------------------

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Lowering:
    """Turns parsed expressions over one DataFrame into columns.

    Only admitted functions have a meaning here; what has none is refused before anything is
    simplified.  Types are looked up in the frame's schema where an operator needs them.
    """

    def __init__(self, df: DataFrame) -> None:
        self.df = df
        self.names = {f.name.lower(): f.name for f in df.schema}

    def kind(self, column: Column) -> T.DataType:
        return self.df.select(column.alias("x")).schema[0].dataType

    def column(self, path) -> Column:
        parts = (path,) if isinstance(path, str) else path
        if parts[0].lower() not in self.names:
            if parts[0].lower() in library.REFUSED:
                raise AdmissionError(f"{parts[0]} is not immutable")
            raise AdmissionError(f"no column {parts[0]}")
        parts = (self.names[parts[0].lower()], *parts[1:])
        return F.col(".".join(f"`{p.replace('`', '``')}`" for p in parts))

    def lower(self, tree: tuple) -> Column:
        what = tree[0]
        if what == "lit":
            return F.lit(tree[1])
        if what == "col":
            return self.column(tree[1])
        if what == "op":
            a, b = self.lower(tree[2]), self.lower(tree[3])
            whole = tree[1] == "/" and isinstance(self.kind(a), _WHOLE) and isinstance(self.kind(b), _WHOLE)
            return binary(tree[1], a, b, whole=whole)
        if what == "unary":
            return unary(tree[1], self.lower(tree[2]))
        if what == "cast":
            return cast(self.lower(tree[1]), library.type_name(tree[2]), tree[3])
        if what == "in":
            value, items = self.lower(tree[1]), tree[2]
            if not items:
                raise AdmissionError("IN needs a list")
            return value.isin(*map(self.lower, items))
        if what == "case":
            arms, default = tree[1], tree[2]
            out = F.when(self.lower(arms[0][0]), self.lower(arms[0][1]))
            for test, value in arms[1:]:
                out = out.when(self.lower(test), self.lower(value))
            return out.otherwise(self.lower(default))
        if what == "interval":
            return F.expr("INTERVAL '" + tree[1].replace("'", "''") + "'")
        if what == "call":
            return library.call(tree[1], [self.lower(a) for a in tree[2]], tree[2])
        raise AdmissionError(f"not an expression: {what}")


def scalar(sql: str, df: DataFrame) -> Column:
    """The column that one admitted scalar SQL expression means over ``df``."""
    return Lowering(df).lower(parse_scalar(sql))


def filter_rows(df: DataFrame, predicate: str | Column | tuple) -> DataFrame:
    """Rows for which ``predicate`` is true; it must be Boolean."""
    if isinstance(predicate, str):
        predicate = parse_scalar(predicate)
    column = Lowering(df).lower(predicate) if isinstance(predicate, tuple) else predicate
    kind = df.select(column.alias("p")).schema[0].dataType
    if not isinstance(kind, T.BooleanType):
        raise ContractError(f"a filter must be boolean, not {kind.simpleString()}")
    return df.where(column)


def project(df: DataFrame, outputs: Sequence[tuple[str, str | tuple]], where: str | tuple | None = None) -> DataFrame:
    """Filter first, then compute (name, expression) outputs.

    Outputs must be there and differ in name; a column passed through keeps its metadata, except
    that its source's name goes when it gets another.
    """
    names = [name.lower() for name, _ in outputs]
    if not names:
        raise ContractError("a projection needs an output")
    if len(set(names)) < len(names):
        raise ContractError("two outputs have one name")
    if where is not None:
        df = filter_rows(df, where)
    lowering, fields = Lowering(df), {f.name: f for f in df.schema}
    columns = []
    for name, expression in outputs:
        tree = parse_scalar(expression) if isinstance(expression, str) else expression
        source = fields.get(lowering.names.get(tree[1].lower(), "")) if tree[0] == "col" and isinstance(tree[1], str) else None
        if source is not None:
            kept = {k: v for k, v in (source.metadata or {}).items() if k != "source_name" or name == source.name}
            columns.append(F.col(f"`{source.name}`").alias(name, metadata=kept))
        else:
            columns.append(lowering.lower(tree).alias(name))
    return df.select(*columns)


def needed_columns(expressions: Sequence[str]) -> set[str]:
    """Columns that all these expressions read together: what a scan must give."""
    return set().union(*(columns_of(parse_scalar(e)) for e in expressions)) if expressions else set()
