"""Token ids of whole texts by a public byte-level BPE tokenizer.

The tokenizer's JSON file decides.  Where the same vocabulary is also at hand as a file of
ranks, texts of well-known letters and signs go through the faster encoder of that
file; texts with special tokens, or with letters whose class may differ between Unicode
versions, always go through the tokenizer itself.
"""

from __future__ import annotations

import base64
import os
import re
from pathlib import Path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Letters whose class may differ between Unicode versions.
UNSURE = re.compile("[^\x00-\x1b\x20-\u052f\u1e00-\u1fff\u2010-\u205f\u20a0-\u20bf]")


def ranks_beside(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer's JSON file as ranks, if a file of them lies beside it."""
    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return None
    pairs = (line.split() for line in ranks.read_bytes().splitlines())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    _known: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if table := ranks_beside(path):
            plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.fast = plain._core_bpe

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def ids(self, text: str) -> bytes:
        if self.fast is None or UNSURE.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return memoryview(self.fast.encode_to_tiktoken_buffer(text, set())).tobytes()
