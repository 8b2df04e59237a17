"""Source positions: how far a scope has read, how positions join, and when one reaches another."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce

from sluice.errors import PositionError


@dataclass(frozen=True)
class Cursor:
    """The greatest value of a column that has been read; kinds: int, uint, decimal, timestamp, string."""

    field: str
    kind: str
    value: str

    def number(self):
        if self.kind in ("int", "uint", "timestamp"):
            return int(self.value)
        return None

    def decimal(self) -> Decimal:
        try:
            return Decimal(self.value)
        except InvalidOperation:
            raise PositionError(f"not a decimal: {self.value}") from None


@dataclass(frozen=True)
class Log:
    """An offset of an ordered log."""

    log: str
    offset: int


@dataclass(frozen=True)
class Files:
    """Files taken: path to identity (size and change time, or an entity tag)."""

    files: tuple[tuple[str, str], ...]

    def mapping(self) -> dict[str, str]:
        return dict(self.files)


@dataclass(frozen=True)
class Snapshot:
    table: str
    snapshot_id: int


@dataclass(frozen=True)
class Page:
    token: str


@dataclass(frozen=True)
class Resume:
    """An opaque token of a change stream."""

    token: str


@dataclass(frozen=True)
class Composite:
    parts: tuple[tuple[str, object], ...]


KINDS = {c.__name__.lower(): c for c in (Cursor, Log, Files, Snapshot, Page, Resume, Composite)}


def join(a, b):
    """The least position that covers both; kinds that differ do not join."""
    if type(a) is not type(b):
        raise PositionError(f"{type(a).__name__} does not join {type(b).__name__}")
    if isinstance(a, Cursor):
        if (a.field, a.kind) != (b.field, b.kind):
            raise PositionError("cursors of different fields or kinds do not join")
        if a.kind == "string":
            return a if a.value >= b.value else b
        key = Cursor.decimal if a.kind == "decimal" else Cursor.number
        return a if key(a) >= key(b) else b
    if isinstance(a, Log):
        if a.log != b.log:
            raise PositionError("offsets of different logs do not join")
        return a if a.offset >= b.offset else b
    if isinstance(a, Files):
        both = a.mapping()
        for path, identity in b.files:
            if both.setdefault(path, identity) != identity:
                raise PositionError(f"{path} has two identities")
        return Files(tuple(sorted(both.items())))
    if isinstance(a, Composite):
        mine, theirs = dict(a.parts), dict(b.parts)
        merged = {k: join(mine[k], theirs[k]) if k in mine and k in theirs else mine.get(k, theirs.get(k)) for k in {*mine, *theirs}}
        return Composite(tuple(sorted(merged.items())))
    if a == b:
        return a
    raise PositionError(f"{type(a).__name__} positions that differ do not join")


def aggregate(positions: list):
    """The join of the positions of many batches."""
    if not positions:
        raise PositionError("nothing to join")
    return reduce(join, positions)


def reaches(a, b) -> bool:
    """Whether ``a`` is at ``b`` or beyond; texts and decimal texts reach only their equals."""
    if type(a) is not type(b):
        return False
    if isinstance(a, Cursor):
        if (a.field, a.kind) != (b.field, b.kind):
            return False
        return a.value == b.value if a.kind in ("string", "decimal") else a.number() >= b.number()
    if isinstance(a, Log):
        return a.log == b.log and a.offset >= b.offset
    if isinstance(a, Files):
        have = a.mapping()
        return all(have.get(p) == i for p, i in b.files)
    if isinstance(a, Composite):
        have = dict(a.parts)
        return all(k in have and reaches(have[k], v) for k, v in b.parts)
    return a == b


def to_json(position) -> str:
    def plain(p):
        body = {"parts": [[k, plain(v)] for k, v in p.parts]} if isinstance(p, Composite) else asdict(p)
        return {"position": type(p).__name__.lower(), **body}

    return json.dumps(plain(position), sort_keys=True, separators=(",", ":"))


def from_json(text: str):
    def build(d: dict):
        d = dict(d)
        kind = KINDS[d.pop("position")]
        if kind is Composite:
            return Composite(tuple((k, build(v)) for k, v in d["parts"]))
        if kind is Files:
            return Files(tuple((p, i) for p, i in d["files"]))
        return kind(**d)

    return build(json.loads(text))
