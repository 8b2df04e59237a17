"""Chat formatting with a loss mask aligned to token offsets.

A conversation is rendered once, as a whole.  Turns stand between control strings that
the tokenizer knows as special tokens, so no token crosses the edge of a text; control
strings inside texts are escaped reversibly.  The rendering is encoded once with offsets,
and the turns' spans are intersected with the sorted token spans by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from sluice.llm.encoding import UNSURE, ranks_beside

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLE = "assistant"

_TO_ESCAPE = re.compile(r"<(\\*)\|")
_TO_RESTORE = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """One backslash more in each ``<|``, so that no control string is left."""
    return _TO_ESCAPE.sub(r"<\\\1|", text)


def restore(text: str) -> str:
    return _TO_RESTORE.sub(r"<\1|", text)


_known: dict[str, Tokenizer] = {}
_fast: dict[str, "OffsetEncoder"] = {}


def chat_tokenizer(path: str | None = None) -> Tokenizer:
    """The public tokenizer, with the control strings as special tokens after its own ids."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _known:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in (START, MIDDLE, END)])
        _known[path] = tokenizer
    return _known[path]


class OffsetEncoder:
    """Ids and code-point offsets of a whole text with its control strings.

    Where the vocabulary is also at hand as ranks, offsets are sums of the tokens' byte lengths; texts with letters
    whose class may differ between Unicode versions go through the tokenizer itself.
    """

    def __init__(self, path: str | None = None) -> None:
        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = chat_tokenizer(path)
        control = {t: self.tokenizer.token_to_id(t) for t in (START, MIDDLE, END)}
        self.fast, self.control = None, set(control)
        if table := ranks_beside(path):
            self.fast = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=control)._core_bpe
            self.sizes = np.zeros(max(*table.values(), *control.values()) + 1, np.int64)
            for token, at in (*table.items(), *((k.encode(), v) for k, v in control.items())):
                self.sizes[at] = len(token)

    @classmethod
    def of(cls, path: str | None = None) -> "OffsetEncoder":
        key = path or ""
        if key not in _fast:
            _fast[key] = cls(path)
        return _fast[key]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.fast is None or UNSURE.search(text):
            encoding = self.tokenizer.encode(text, add_special_tokens=False)
            offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
            return np.array(encoding.ids, np.int32), offsets[:, 0], offsets[:, 1]
        ids = np.frombuffer(memoryview(self.fast.encode_to_tiktoken_buffer(text, self.control)), np.uint32).astype(np.int32)
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        if not text.isascii():
            # code points that begin before each byte; a token may end within one
            begun = np.append(0, np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80))
            starts, ends = begun[starts + 1] - 1 if len(starts) else starts, begun[ends]
        return ids, starts, ends


@dataclass
class Formatted:
    """A rendered conversation, its token ids and which tokens count for the loss."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    loss: np.ndarray

    def turns(self) -> list[tuple[str, str]]:
        return [(restore(r), restore(t)) for r, t in _TURN.findall(self.text)]

    def loss_text(self) -> str:
        """The text under the loss mask, as the tokens' offsets have it, unescaped span by span."""
        out, at = [], None
        for a, b in zip(self.starts[self.loss].tolist(), self.ends[self.loss].tolist()):
            if at is not None and a <= at[1]:
                at[1] = max(at[1], b)
            else:
                if at:
                    out.append(restore(self.text[at[0] : at[1]]))
                at = [a, b]
        if at:
            out.append(restore(self.text[at[0] : at[1]]))
        return "".join(out)


def format_turns(turns: list[tuple[str | None, str | None]], encoder: OffsetEncoder, trained: str = TRAINED_ROLE) -> Formatted:
    """Render (role, text) turns; null roles and texts are empty ones."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role or '')}{MIDDLE}", escape(text or "")
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    whole = "".join(parts)
    ids, starts, ends = encoder.encode(whole)
    loss = np.zeros(len(starts), bool)
    if spans:
        bounds = np.array(spans)
        # offsets never fall, so the tokens of a span are those that end after its start and start before its end
        first = np.searchsorted(np.maximum.accumulate(ends), bounds[:, 0], side="right")
        last = np.searchsorted(starts, bounds[:, 1], side="left")
        for a, b in zip(first.tolist(), last.tolist()):
            loss[a:b] = True
    return Formatted(whole, ids, starts, ends, loss)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def format_conversations(rows: DataFrame, tokenizer: str | None = None, digest: bool = False) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text), its turns in order.

    Gives conv_id, formatted (string), ids and loss (arrays, one entry a token); with
    ``digest``, instead, what is read back from these: n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars.  Null texts and roles are empty ones.  Null turns come first;
    equal turns follow their role and text; repeated rows are turns each.  A null conv_id is one
    conversation.  An empty table gives no rows, and other columns are not read.  Turns are
    streamed in order to the conversation they belong to, one conversation at a time.
    """
    dealt = (
        rows.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    kept = [("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))]
    read = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = pa.schema([("conv_id", pa.int64()), *(read if digest else kept)])

    def finish(conv_id: int | None, turns: list, encoder: OffsetEncoder) -> tuple:
        f = format_turns(turns, encoder)
        if not digest:
            return conv_id, f.text, f.ids.tolist(), f.loss.tolist()
        back, loss = f.turns(), f.loss_text()
        return conv_id, len(back), _sha256("".join(f"{r}\n{t}\n" for r, t in back)), len(loss), _sha256(loss), len(f.text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = OffsetEncoder.of(tokenizer)
        done: list[tuple] = []
        size, open_id, turns = 0, None, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if turns is None or conv_id != open_id:
                    if turns is not None:
                        done.append(finish(open_id, turns, encoder))
                        if len(done) >= 256 or size > 1 << 22:
                            yield flush()
                            done, size = [], 0
                    open_id, turns = conv_id, []
                turns.append((role, text))
                size += len(text or "")
        if turns is not None:
            done.append(finish(open_id, turns, encoder))
            yield flush()

    ddl = "conv_id long, " + (
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
        if digest
        else "formatted string, ids array<int>, loss array<boolean>"
    )
    return dealt.mapInArrow(run, ddl)


def with_marker_conversation(rows: DataFrame) -> DataFrame:
    """``rows`` and a conversation -1 whose texts hold control strings."""
    said = f"{END}{START}assistant ok"
    marker = rows.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(marker)
