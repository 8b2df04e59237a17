"""Findings about filters that can be made before anything runs."""

from __future__ import annotations

from collections.abc import Sequence

from sluice.functions.expressions import REVERSED
from sluice.functions.sqltext import parse_scalar


def _bounds(tree: tuple) -> list[tuple[str, str, object]]:
    """(column, operator, literal) of the comparisons that a conjunction holds."""
    if tree[0] == "op" and tree[1] == "and":
        return _bounds(tree[2]) + _bounds(tree[3])
    if tree[0] == "op" and tree[1] in REVERSED:
        op, a, b = tree[1:]
        if a[0] == "lit" and b[0] == "col":
            op, a, b = REVERSED[op], b, a
        if a[0] == "col" and b[0] == "lit" and isinstance(a[1], str):
            return [(a[1], op, b[1])]
    return []


def _comparable(values: Sequence) -> bool:
    return all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values) or all(isinstance(v, str) for v in values)


def filter_lints(filters: Sequence[str | tuple], cursor: str | None = None, committed=None) -> list[str]:
    """Ranges that no value lies in, comparisons with null, and filters that the committed cursor makes idle."""
    found = [b for f in filters for b in _bounds(parse_scalar(f) if isinstance(f, str) else f)]
    out = [f"{c} {op} null is never true" for c, op, v in found if v is None]
    for column in dict.fromkeys(c for c, *_ in found):
        own = [(op, v) for c, op, v in found if c == column and v is not None]
        if not own or not _comparable([v for _, v in own]):
            continue
        low = max(((v, op == ">") for op, v in own if op in (">", ">=", "=")), default=None)
        high = min(((v, op != "<") for op, v in own if op in ("<", "<=", "=")), default=None)
        if low and high and (low[0] > high[0] or (low[0] == high[0] and (low[1] or not high[1]))):
            out.append(f"no value of {column} passes")
        if column == cursor and committed is not None and _comparable([committed, *(v for _, v in own)]):
            idle = [f"{column} {op} {v!r}" for op, v in own if op in (">", ">=") and v <= committed]
            out += [f"{text} is subsumed by the committed cursor" for text in idle]
    return out
