"""Finite drains of a stream, epoch by epoch: each epoch is a package, a receipt and a checkpoint.

One micro-batch of an ``availableNow`` query is one frontier.  The controller decides on counts
alone when frontiers close a package and when the drain ends, and the drain does what it says: frontiers of an
open epoch are written to shared storage and settled together when the epoch closes; rows stay in the executors.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import time
from collections.abc import Callable
from dataclasses import astuple, dataclass, field
from decimal import Decimal

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.errors import ContractError, PositionError
from sluice.operators.late import LATE, LateSplit, split_late
from sluice.plans.resource import Execution
from sluice.storage import Folder


@dataclass(frozen=True)
class Magnitudes:
    """What an epoch has gathered; None is unmeasurable and trips nothing."""

    batches: int = 0
    rows: int | None = 0
    bytes: int | None = 0
    elapsed_ms: int | None = 0
    watermark_advance: int | None = None

    def plus(self, other: "Magnitudes") -> "Magnitudes":
        both = lambda a, b: None if a is None or b is None else a + b
        return Magnitudes(self.batches + other.batches, both(self.rows, other.rows), both(self.bytes, other.bytes), both(self.elapsed_ms, other.elapsed_ms), other.watermark_advance if other.watermark_advance is not None else self.watermark_advance)

    def trips(self, trigger: tuple[str, int] | None) -> bool:
        if trigger is None:
            return False
        value = getattr(self, trigger[0])
        return value is not None and value >= trigger[1]


@dataclass
class Controller:
    """Closes epochs; termination comes before package rotation, rotation before checkpoint cadence."""

    execution: Execution
    epoch: Magnitudes = Magnitudes()
    since_checkpoint: Magnitudes = Magnitudes()
    total: Magnitudes = Magnitudes()

    def offer(self, seen: Magnitudes, *, source_done: bool = False, frontier_reached: bool = False) -> str:
        """What follows after a safe frontier: terminate, rotate, checkpoint or continue."""
        self.epoch, self.since_checkpoint, self.total = (m.plus(seen) for m in (self.epoch, self.since_checkpoint, self.total))
        kind, bound = self.execution.until or ("quiescent", 0)
        limit = {"duration_ms": self.total.elapsed_ms, "records": self.total.rows, "bytes": self.total.bytes}.get(kind)
        if (kind == "quiescent" and source_done) or (kind == "frontier" and frontier_reached) or (limit is not None and limit >= bound) or source_done:
            return "terminate"
        if self.epoch.trips(self.execution.package):
            self.epoch = self.since_checkpoint = Magnitudes()
            return "rotate"
        if self.since_checkpoint.trips(self.execution.checkpoint):
            self.since_checkpoint = Magnitudes()
            return "checkpoint"
        return "continue"


_KINDS = {"int": int, "datetime": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "Decimal": Decimal, "str": str}


def _typed(value) -> list | None:
    return None if value is None else [type(value).__name__, value.isoformat() if isinstance(value, dt.date) else str(value)]


def _untyped(pair: list | None):
    return None if pair is None else _KINDS[pair[0]](pair[1])


@dataclass(frozen=True)
class Progress:
    """What a frontier leaves: the committed watermark, the claims so far, and the epoch that is open with its frontiers."""

    watermark: object = None
    claims: dict = field(default_factory=dict)
    epoch: int = 0
    pending: tuple[int, ...] = ()
    gathered: Magnitudes = Magnitudes()
    since_checkpoint: Magnitudes = Magnitudes()


class EpochState:
    """What frontiers leave to the next one, in a folder of shared storage: progress, open epochs' rows, withheld rows.

    A frontier reads what the one before it left, so one that runs again after a crash decides alike.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)

    def load(self, frontier: int) -> Progress:
        """Progress after a frontier; none before the first."""
        name = f"frontiers/{frontier:012d}.json"
        if not self.folder.exists(name):
            return Progress()
        found = json.loads(self.folder.read(name))
        claims = {_untyped(k): _untyped(v) for k, v in found["claims"]}
        return Progress(_untyped(found["watermark"]), claims, found["epoch"], tuple(found["pending"]), Magnitudes(*found["gathered"]), Magnitudes(*found["since_checkpoint"]))

    def save(self, frontier: int, p: Progress) -> None:
        claims = [[_typed(k), _typed(v)] for k, v in sorted(p.claims.items(), key=str)]
        body = {"watermark": _typed(p.watermark), "claims": claims, "epoch": p.epoch, "pending": p.pending, "gathered": astuple(p.gathered), "since_checkpoint": astuple(p.since_checkpoint)}
        self.folder.write(f"frontiers/{frontier:012d}.json", json.dumps(body, sort_keys=True), overwrite=True)

    def latest(self) -> int | None:
        found = [int(name.removesuffix(".json")) for name, *_ in self.folder.list("frontiers") if name.endswith(".json") and not name.startswith(".")]
        return max(found, default=None)

    def stage(self, frontier: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/pending/{frontier:012d}")

    def staged(self, frontiers: tuple[int, ...]) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.root}/pending/{f:012d}") for f in frontiers]

    def withhold(self, epoch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/late/{epoch:012d}")

    def withheld(self, epoch: int) -> DataFrame | None:
        name = f"late/{epoch:012d}"
        return self.spark.read.parquet(f"{self.root}/{name}") if self.folder.exists(f"{name}/_SUCCESS") else None


class DrainEnded(Exception):
    """A frontier came after the drain had ended; it stays with the source, for the next drain."""


@dataclass
class Drain:
    """Runs the micro-batches of a stream as epochs with committed watermarks and late rows.

    ``settle(rows, quarantined, epoch, watermark)`` delivers one epoch and must be idempotent by epoch number.  An
    epoch closes when the execution's package trigger says so, and the last one when the drain ends: because the source has nothing
    more, or at the bound that the execution sets, behind which frontiers are left to the next drain.
    Rows are late against the watermark that earlier epochs committed.  Recaptured rows are held back once and admitted with the
    next epoch, whatever the watermark is then.

    Claims are the greatest event times seen in each source partition; or those of the column ``claim``, which the
    source itself makes, and which must not go back.  The watermark waits while any partition seen, or named in
    ``partitions``, has no claim, but for ``idle`` ones.  Bytes are those of rows as JSON text.
    """

    execution: Execution
    settle: Callable[[DataFrame, DataFrame, int, object], object]
    state: EpochState
    partition: str | None = None
    event_time: str | None = None
    claim: str | None = None
    partitions: tuple = ()
    idle: tuple = ()
    watermark: object = None
    log: list = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.execution.kind != "drain":
            raise ContractError("a drain needs EXECUTION DRAIN")
        self.controller = Controller(self.execution)
        self.ended, self._last = False, time.monotonic()

    def on_batch(self, batch: DataFrame, frontier: int) -> None:
        if self.ended:
            raise DrainEnded(f"frontier {frontier} comes after the drain")
        p = self.state.load(frontier - 1)
        self.controller.epoch, self.controller.since_checkpoint = p.gathered, p.since_checkpoint
        rows, size, claims = self._measured(batch, p.claims)
        low = self._low(claims, p.watermark)
        now = time.monotonic()
        seen = Magnitudes(1, rows, size, int((now - self._last) * 1000), _advance(p.watermark, low))
        self._last = now
        kind, bound = self.execution.until or ("quiescent", 0)
        decision = self.controller.offer(seen, frontier_reached=kind == "frontier" and low is not None and low >= bound)
        if decision in ("terminate", "rotate"):
            p = self._close([*self.state.staged(p.pending), batch], p, claims)
        else:
            self.state.stage(frontier, batch)
            p = Progress(p.watermark, claims, p.epoch, (*p.pending, frontier), self.controller.epoch, self.controller.since_checkpoint)
        self.state.save(frontier, p)
        self.watermark = p.watermark
        self.log.append((frontier, decision))
        self.ended = decision == "terminate"

    def _measured(self, batch: DataFrame, claims: dict) -> tuple[int, int, dict]:
        """Rows, bytes and the claims after a batch; one row a source partition, whose number is the source's, not the data's."""
        size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
        measures = [F.count(F.lit(1)).alias("rows"), size.alias("bytes")]
        if not (self.event_time and self.partition):
            r = batch.agg(*measures).first()
            return r["rows"], r["bytes"], claims
        claims = dict(claims)
        found = batch.groupBy(F.col(self.partition).alias("part")).agg(F.max(self.claim or self.event_time).alias("claim"), *measures).collect()
        for r in found:
            old, new = claims.get(r["part"]), r["claim"]
            if self.claim and old is not None and new is not None and new < old:
                raise PositionError(f"the watermark of partition {r['part']} went back from {old} to {new}")
            claims[r["part"]] = old if new is None else new if old is None else max(old, new)
        return sum(r["rows"] for r in found), sum(r["bytes"] for r in found), claims

    def _low(self, claims: dict, before):
        """The least claim, never before the committed watermark; that one while any partition that is not idle has no claim."""
        known = [claims.get(k) for k in {*claims, *self.partitions} if k not in self.idle]
        if not known or any(v is None for v in known):
            return before
        return min(known) if before is None else max(before, min(known))

    def _close(self, parts: list[DataFrame], p: Progress, claims: dict) -> Progress:
        """Settle the open epoch; then the watermark of its claims is committed."""
        rows = functools.reduce(DataFrame.unionByName, parts)
        if self.event_time and p.watermark is not None:
            split = split_late(rows, self.event_time, p.watermark, self.execution.late)
        else:
            none = rows.where(F.lit(False))
            split = LateSplit(rows.withColumn(LATE, F.lit(False)) if self.execution.late == "admit_with_annotation" and self.event_time else rows, none, none)
        admitted = split.admitted
        if (held := self.state.withheld(p.epoch - 1)) is not None:
            admitted = admitted.unionByName(held)
        self.settle(admitted, split.quarantined, p.epoch, p.watermark)
        if self.execution.late == "recapture_next_epoch":
            self.state.withhold(p.epoch, split.carried)
        return Progress(self._low(claims, p.watermark), claims, p.epoch + 1)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Drain what the stream has now.  ``checkpoint`` is the query's own folder, in shared storage."""
        if not stream.isStreaming:
            raise PositionError("a drain reads a stream")
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(self.on_batch).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not self.ended:
                raise
        if not self.ended and (last := self.state.latest()) is not None:
            # the source has nothing more: the open epoch is settled as it is
            p = self.state.load(last)
            if p.pending:
                p = self._close(self.state.staged(p.pending), p, p.claims)
                self.state.save(last, p)
            self.watermark, self.ended = p.watermark, True


def _advance(before, after) -> int | None:
    """How far a watermark came: in its own unit, days for dates, milliseconds for times; None if that has no measure."""
    if before is None or after is None:
        return None
    if isinstance(after, dt.datetime):
        return int((after - before).total_seconds() * 1000)
    if isinstance(after, dt.date):
        return (after - before).days
    return int(after - before) if isinstance(after, (int, Decimal)) else None
