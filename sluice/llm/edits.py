"""Edit-aware token counts: a tree of pre-tokens per document.

Blocks of pre-tokens hang in a balanced tree whose nodes carry the sums of their subtree.
An edit re-reads the text from one pre-token before the first that it can touch, until
a boundary falls on an old one behind the edit, re-encodes only those pre-tokens, and
replaces the blocks they lie in; sums change along the paths to them.
"""

from __future__ import annotations

import base64
import random
import re
from collections.abc import Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sluice.llm.common import slices
from sluice.llm.encoding import UNSURE

BLOCK = 64

Edit = tuple[int, int, str]


class PieceCounter:
    """Pre-tokens of a text and how many ids each has; special tokens are ordinary text.

    Code points whose class differs between Unicode versions are taken for what the tokenizer's
    JSON file beside the ranks makes of them, so that counts agree with the tokenizer's.
    """

    CACHE = 200_000
    _known: dict[str, "PieceCounter"] = {}

    def __init__(self, ranks: str) -> None:
        pairs = (line.split() for line in Path(ranks).read_bytes().splitlines())
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.core = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe
        self.cache: dict[str, int] = {}
        whole = Path(ranks).with_suffix(".json")
        self.split = Tokenizer.from_file(str(whole)).pre_tokenizer.pre_tokenize_str if whole.exists() else None
        self.alike: dict[str, str] = {}

    def plain(self, text: str) -> str:
        """``text`` with a well-known code point of the same class in place of each unsure one, to be matched."""
        return UNSURE.sub(self._like, text) if self.split and UNSURE.search(text) else text

    def _like(self, m: re.Match[str]) -> str:
        c = m[0]
        if c not in self.alike:
            if len(self.alike) > self.CACHE:
                self.alike.clear()
            self.alike[c] = next((like for like in "x0!" if len(self.split(like + c + like)) == 1), "\t")
        return self.alike[c]

    def pieces(self, text: str) -> list[str]:
        plain = self.plain(text)
        if plain is text:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    @classmethod
    def of(cls, ranks: str) -> "PieceCounter":
        if ranks not in cls._known:
            cls._known[ranks] = cls(ranks)
        return cls._known[ranks]

    def counts(self, pieces: list[str]) -> list[int]:
        cache = self.cache
        found = [cache.get(p) for p in pieces]
        if None in found:
            if len(cache) > self.CACHE:
                cache.clear()
            for i, n in enumerate(found):
                if n is None:
                    piece = pieces[i]
                    found[i] = n = len(self.core.encode_single_piece(piece.encode("utf-8")))
                    if len(piece) <= 32:
                        cache[piece] = n
        return found


class _Node:
    __slots__ = ("pieces", "counts", "rank", "left", "right", "own", "own_tokens", "chars", "tokens")

    def __init__(self, pieces: list[str], counts: list[int], rank: float) -> None:
        self.pieces, self.counts, self.rank = pieces, counts, rank
        self.left: _Node | None = None
        self.right: _Node | None = None
        self.own, self.own_tokens = sum(map(len, pieces)), sum(counts)
        self.chars, self.tokens = self.own, self.own_tokens


def _sum(node: _Node) -> _Node:
    a, b = node.left, node.right
    node.chars = node.own + (a.chars if a else 0) + (b.chars if b else 0)
    node.tokens = node.own_tokens + (a.tokens if a else 0) + (b.tokens if b else 0)
    return node


def _merge(a: _Node | None, b: _Node | None) -> _Node | None:
    if not a or not b:
        return a or b
    if a.rank > b.rank:
        a.right = _merge(a.right, b)
        return _sum(a)
    b.left = _merge(a, b.left)
    return _sum(b)


def _split(node: _Node | None, chars: int) -> tuple[_Node | None, _Node | None]:
    """Blocks that end at ``chars`` or before, and the rest."""
    if not node:
        return None, None
    left = node.left.chars if node.left else 0
    if left + node.own <= chars:
        node.right, rest = _split(node.right, chars - left - node.own)
        return _sum(node), rest
    first, node.left = _split(node.left, chars)
    return first, _sum(node)


def _blocks(node: _Node | None) -> Iterator[_Node]:
    stack = []
    while stack or node:
        while node:
            stack.append(node)
            node = node.left
        node = stack.pop()
        yield node
        node = node.right


class TokenTree:
    """The pre-tokens of one text, its token count, and edits that keep both right."""

    def __init__(self, text: str, counter: PieceCounter, block: int = BLOCK) -> None:
        self.counter, self.block, self.random = counter, block, random.Random(17)
        self.reencoded = 0
        pieces = counter.pieces(text)
        self.root = self._build(pieces, counter.counts(pieces))

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def text(self) -> str:
        return "".join(p for b in _blocks(self.root) for p in b.pieces)

    def _build(self, pieces: list[str], counts: list[int]) -> _Node | None:
        nodes = [_Node(pieces[i : i + self.block], counts[i : i + self.block], self.random.random()) for i in range(0, len(pieces), self.block)]
        while len(nodes) > 1:
            nodes = [_merge(nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None) for i in range(0, len(nodes), 2)]
        return nodes[0] if nodes else None

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace code points ``start`` to ``end`` by ``new``."""
        if not 0 <= start <= end <= self.chars:
            raise IndexError(f"{start}:{end} is not within 0:{self.chars}")
        before, rest = _split(self.root, max(0, start - 1))
        # one block of context, so that the pre-token before the first touched is at hand
        if before:
            head, last = _split(before, before.chars - 1)
            before, rest = head, _merge(last, rest)
        base = before.chars if before else 0
        old: list[str] = []
        old_counts: list[int] = []
        old_chars = 0

        def take() -> bool:
            nonlocal rest, old_chars
            first = rest
            if not first:
                return False
            while first.left:
                first = first.left
            one, rest = _split(rest, first.own)
            old.extend(one.pieces)
            old_counts.extend(one.counts)
            old_chars += one.chars
            return True

        while base + old_chars < end + 1 and take():
            pass
        lo, at = 0, base
        while lo < len(old) and at + len(old[lo]) < start:
            at += len(old[lo])
            lo += 1
        # the pre-token before the first that reaches the edit looks one code point further
        if lo:
            lo -= 1
            at -= len(old[lo])
        text = "".join(old[lo:])
        text = text[: start - at] + new + text[end - at :]
        shift, edited = len(new) - (end - start), start - at + len(new)
        ends: dict[int, int] = {}
        where = at
        for k in range(lo, len(old)):
            where += len(old[k])
            ends[where + shift - at] = k + 1
        fresh: list[str] = []
        pos, keep = 0, len(old)
        plain, match = self.counter.plain(text), self.counter.pattern.match
        while True:
            if pos >= edited and pos in ends:
                # what follows is read as before from here, whatever stands behind
                keep = ends[pos]
                break
            m = match(plain, pos) if pos < len(text) else None
            if m is None or m.end() == len(text):
                grown = len(old)
                if take():
                    more = "".join(old[grown:])
                    text += more
                    plain += self.counter.plain(more)
                    for k in range(grown, len(old)):
                        where += len(old[k])
                        ends[where + shift - at] = k + 1
                    continue
                if m is None:
                    keep = len(old)
                    break
            fresh.append(text[pos : m.end()])
            pos = m.end()
        counts = self.counter.counts(fresh)
        self.reencoded += len(fresh)
        middle = self._build(old[:lo] + fresh + old[keep:], old_counts[:lo] + counts + old_counts[keep:])
        self.root = _merge(_merge(before, middle), rest)


def sample_edits(doc_id: int | None, n_chars: int) -> list[Edit]:
    """Three edits that follow from a doc_id and a length: a replacement, an insertion, a deletion."""
    draw = random.Random(doc_id or 0)
    word = "".join(draw.choice("aeiou rstln 0'.") for _ in range(draw.randint(1, 12)))
    a = draw.randint(0, n_chars)
    b = min(n_chars, a + draw.randint(0, 20))
    n = n_chars + len(word) - (b - a)
    c = draw.randint(0, n)
    n += 2
    d = draw.randint(0, n)
    return [(a, b, word), (c, c, " x"), (d, min(n, d + draw.randint(0, 15)), "")]


def edited_counts(docs: DataFrame, edits=sample_edits, ranks: str | None = None) -> DataFrame:
    """Token counts of every whole text before and after its edits.

    Gives doc_id, n_pieces, n_tokens, n_edits, n_chars_edited, n_tokens_edited and n_reencoded
    (pre-tokens that the edits had encoded again).  ``edits`` maps a doc_id and a length to (start,
    end, new) triples that apply in turn.  Null texts are empty ones, to which edits apply too;
    repeated rows and null doc_ids are kept; an empty table gives no rows.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = ["doc_id", "n_pieces", "n_tokens", "n_edits", "n_chars_edited", "n_tokens_edited", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(path)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = TokenTree(text or "", counter)
                n_pieces, n_tokens, todo = sum(len(b.pieces) for b in _blocks(tree.root)), tree.tokens, edits(doc_id, tree.chars)
                for e in todo:
                    tree.edit(*e)
                rows.append((doc_id, n_pieces, n_tokens, len(todo), tree.chars, tree.tokens, tree.reencoded))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
