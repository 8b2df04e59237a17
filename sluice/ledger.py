"""Append-only checkpoints: state moves on only with the receipt that covers it."""

from __future__ import annotations

import json
import time
import uuid
import zlib
from dataclasses import asdict, dataclass

from sluice import positions
from sluice.errors import PositionError
from sluice.sinks.lake import Receipt
from sluice.storage import Folder


@dataclass(frozen=True)
class Checkpoint:
    sequence: int
    checkpoint_id: str
    pipeline_id: str
    resource_id: str
    scope_json: str
    status: str  # proposed, committed, abandoned or rewound
    input_position_json: str | None = None
    output_position_json: str | None = None
    watermark: str | None = None
    package_hash: str | None = None
    schema_hash: str | None = None
    receipt_id: str | None = None
    parent_checkpoint_id: str | None = None
    rewind_target_checkpoint_id: str | None = None
    created_at_ms: int = 0
    quarantined_rows: int = 0


class Ledger:
    """Checkpoints of one pipeline, one object each, under a folder."""

    def __init__(self, folder: Folder, pipeline_id: str = "default") -> None:
        self.folder, self.pipeline_id = folder, pipeline_id

    def history(self, resource_id: str, scope: str = "resource") -> list[Checkpoint]:
        base = f"ledger/{self.pipeline_id}/{resource_id}"
        found = [Checkpoint(**json.loads(self.folder.read(f"{base}/{n}"))) for n, *_ in self.folder.list(base) if n.endswith(".json")]
        return sorted((c for c in found if c.scope_json == scope), key=lambda c: c.sequence)

    def all(self) -> list[Checkpoint]:
        base = f"ledger/{self.pipeline_id}"
        return [Checkpoint(**json.loads(self.folder.read(f"{base}/{r}/{n}"))) for r, *_ in self.folder.list(base) for n, *_ in self.folder.list(f"{base}/{r}") if n.endswith(".json")]

    def head(self, resource_id: str, scope: str = "resource") -> Checkpoint | None:
        """The committed checkpoint in force: the latest, or the one that a later rewind names."""
        entries = self.history(resource_id, scope)
        by_id = {c.checkpoint_id: c for c in entries}
        for c in reversed(entries):
            if c.status == "committed":
                return c
            if c.status == "rewound":
                return by_id.get(c.rewind_target_checkpoint_id)
        return None

    def _append(self, resource_id: str, scope: str, **values) -> Checkpoint:
        sequence = 1 + max((c.sequence for c in self.history(resource_id, scope)), default=0)
        c = Checkpoint(sequence, uuid.uuid4().hex, self.pipeline_id, resource_id, scope, created_at_ms=int(time.time() * 1000), **values)
        name = f"ledger/{self.pipeline_id}/{resource_id}/{zlib.crc32(scope.encode()):08x}-{sequence:012d}.json"
        if self.folder.exists(name):
            raise PositionError(f"another run committed {resource_id} {sequence} first")
        self.folder.write(name, json.dumps(asdict(c), sort_keys=True))
        return c

    def commit(self, resource_id: str, receipt: Receipt | None, position=None, scope: str = "resource", watermark: str | None = None, **values) -> Checkpoint:
        """Commit a state that a receipt covers; neither position nor watermark goes back."""
        if receipt is None:
            raise PositionError("no checkpoint without a receipt")
        head = self.head(resource_id, scope)
        before = head.output_position_json if head else None
        if position is not None and before is not None:
            old = positions.from_json(before)
            if type(old) is type(position) and isinstance(position, (positions.Cursor, positions.Log)) and not positions.reaches(position, old) and position != old:
                if not (isinstance(position, positions.Cursor) and position.kind in ("string", "decimal")):
                    raise PositionError("the position would go back")
        if head and head.watermark is not None:
            if watermark is None:
                watermark = head.watermark
            elif watermark < head.watermark:
                raise PositionError("the watermark would go back")
        return self._append(
            resource_id, scope, status="committed", receipt_id=receipt.receipt_id, package_hash=receipt.token, schema_hash=receipt.schema_hash, input_position_json=before,
            output_position_json=positions.to_json(position) if position is not None else before, watermark=watermark, parent_checkpoint_id=head.checkpoint_id if head else None, **values,
        )

    def rewind(self, resource_id: str, checkpoint_id: str, scope: str = "resource") -> Checkpoint:
        """Append a marker that puts an earlier committed checkpoint in force."""
        if not any(c.checkpoint_id == checkpoint_id and c.status == "committed" for c in self.history(resource_id, scope)):
            raise PositionError(f"no committed checkpoint {checkpoint_id}")
        return self._append(resource_id, scope, status="rewound", rewind_target_checkpoint_id=checkpoint_id)

    def abandon(self, resource_id: str, scope: str = "resource") -> Checkpoint:
        return self._append(resource_id, scope, status="abandoned")

    def clean_runs(self, resource_id: str, scope: str = "resource") -> int:
        """Committed runs without quarantined rows, counted back from the latest."""
        n = 0
        for c in reversed([c for c in self.history(resource_id, scope) if c.status == "committed"]):
            if c.quarantined_rows:
                break
            n += 1
        return n

