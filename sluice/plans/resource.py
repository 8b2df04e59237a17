"""What is known of a resource before it runs: descriptor, capabilities and delivery guarantees."""

from __future__ import annotations

from dataclasses import dataclass, field

from sluice.errors import ContractError

DISPOSITIONS = ("append", "replace", "merge", "cdc_apply")
DELETE_POLICIES = ("ignore", "hard", "soft")


@dataclass(frozen=True)
class Delete:
    """What a change-apply load does with deleted keys; ``soft`` sets the marker column."""

    policy: str = "ignore"
    marker: str | None = None

    def __post_init__(self) -> None:
        if self.policy not in DELETE_POLICIES or (self.policy == "soft") != (self.marker is not None):
            raise ContractError("DELETE is IGNORE, HARD or SOFT(marker)")


@dataclass(frozen=True)
class Route:
    field: str
    max_targets: int


@dataclass(frozen=True)
class Execution:
    """Bounded, or drained in epochs; see ``sluice.streaming.epochs`` for triggers and terminations."""

    kind: str = "bounded"
    checkpoint: tuple[str, int] | None = None
    package: tuple[str, int] | None = None
    until: tuple[str, int] | None = None
    late: str = "quarantine"
    watermark_column: str | None = None
    transaction_limit_bytes: int | None = None

    def __post_init__(self) -> None:
        if self.kind == "resident":
            raise ContractError("resident execution is refused: drain in epochs")
        if self.kind not in ("bounded", "drain"):
            raise ContractError(f"unknown execution {self.kind}")


@dataclass(frozen=True)
class Resource:
    """A described unit of extraction."""

    resource_id: str
    source: str
    arguments: dict = field(default_factory=dict)
    outputs: tuple[tuple[str, tuple], ...] | None = None
    where: tuple | None = None
    target: str | None = None
    disposition: str = "replace"
    keys: tuple[str, ...] = ()
    delete: Delete = Delete()
    route: Route | None = None
    cursor: str | None = None
    trust: str = "governed"
    semantics: dict[str, str] = field(default_factory=dict)
    execution: Execution = Execution()
    exact_row_dedup: bool = False

    def __post_init__(self) -> None:
        if self.disposition not in DISPOSITIONS:
            raise ContractError(f"unknown disposition {self.disposition}")
        if (self.disposition in ("merge", "cdc_apply")) != bool(self.keys):
            raise ContractError(f"{self.disposition} {'needs a' if not self.keys else 'takes no'} merge key")
        if self.exact_row_dedup and self.disposition != "append":
            raise ContractError("exact-row dedup goes with append only")
        if self.delete.policy != "ignore" and self.disposition != "cdc_apply":
            raise ContractError("DELETE goes with CDC_APPLY only")


@dataclass(frozen=True)
class SourceSheet:
    """What a source does itself of a scan."""

    projection: bool
    filters: frozenset[str]
    fidelity: str  # exact, inexact or none
    order: bool
    limit: str  # yes, no or without_cursor
    incremental: tuple[str, ...]


_SIX = frozenset(("=", "!=", "<", "<=", ">", ">="))
_FIVE = _SIX - {"!="}
SOURCES = {
    "parquet": SourceSheet(True, _SIX, "exact", False, "no", ("file",)),
    "text": SourceSheet(False, frozenset(), "none", False, "no", ("file",)),
    "postgres": SourceSheet(True, _FIVE, "exact", True, "yes", ("cursor", "full")),
    "mysql": SourceSheet(True, _FIVE, "exact", True, "yes", ("cursor", "full")),
    "sqlite": SourceSheet(True, _FIVE, "inexact", True, "no", ("cursor", "full")),
    "clickhouse": SourceSheet(True, _FIVE, "exact", True, "without_cursor", ("cursor", "full")),
    "mongodb": SourceSheet(True, _FIVE, "exact", True, "without_cursor", ("cursor", "full")),
    "mongodb_changes": SourceSheet(False, frozenset(), "none", False, "no", ("cdc",)),
    "rest": SourceSheet(False, frozenset((">", ">=", "=")), "inexact", False, "no", ("cursor", "full")),
    "iceberg": SourceSheet(True, frozenset(), "none", False, "no", ("snapshot",)),
    "glue": SourceSheet(False, _SIX, "exact", False, "no", ("file",)),
}


@dataclass(frozen=True)
class DestinationSheet:
    """What a destination takes; types are lossless unless listed."""

    dispositions: frozenset[str]
    atomicity: str
    lossy: frozenset[str] = frozenset()
    unsupported: frozenset[str] = frozenset()


_THREE = frozenset(("append", "replace", "merge"))
DESTINATIONS = {
    "duckdb": DestinationSheet(frozenset(DISPOSITIONS), "package", unsupported=frozenset(("float16", "union"))),
    "postgres": DestinationSheet(frozenset(DISPOSITIONS), "package", lossy=frozenset(("map", "struct", "array")), unsupported=frozenset(("union",))),
    "sqlite": DestinationSheet(_THREE, "package", lossy=frozenset(("decimal", "timestamp", "timestamp_ntz", "date")), unsupported=frozenset(("map", "struct", "array", "union"))),
    "clickhouse": DestinationSheet(_THREE, "target", unsupported=frozenset(("map", "struct", "union"))),
    # merge and cdc_apply on Parquet are an extension: they stage and republish
    "parquet": DestinationSheet(frozenset(DISPOSITIONS), "target", lossy=frozenset(("void",)), unsupported=frozenset(("union",))),
}

#: Delivery by disposition: as planned, and as a receipt confirms it.
GUARANTEES = {"append": ("at_least_once", "per_package"), "replace": ("at_least_once", "per_target"), "merge": ("at_least_once", "per_key"), "cdc_apply": ("at_least_once", "per_position")}


def delivery_guarantee(disposition: str, receipt: bool) -> str:
    return GUARANTEES[disposition][receipt]


def pushdown(sheet: SourceSheet, op: str) -> str:
    """exact, inexact or unsupported; all but exact predicates are applied again after the scan."""
    return sheet.fidelity if op in sheet.filters else "unsupported"


def pushes_limit(sheet: SourceSheet, ops: list[str], cursor: bool) -> bool:
    """A limit goes to the source only if all filters are exact there."""
    if sheet.limit == "no" or (sheet.limit == "without_cursor" and cursor):
        return False
    return all(pushdown(sheet, op) == "exact" for op in ops)
