"""Secret scans: patterns, then structural confirmation of what base64 or hex hides.

The base patterns report as they are.  Beside them, runs of base64 or hex are decoded, joined over line ends
(escaped ones too) or taken between the hyphens and underscores that may glue a prefix to them, and
reported only if what comes out has the structure of a secret: a key in DER whose
nested lengths fill it exactly, an OpenSSH key container, an armoured key (encrypted ones by their
headers and block size), a signed token whose header is
JSON naming its algorithm, or text in which any of this is found again, however often it is encoded.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.common import map_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "key", "encoded")
MASK = "[secret]"

_ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
)
_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"[0-9a-f]{32,}+")
_SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
#: Line ends may be escaped, once or more often, as in a key kept in JSON.
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}?)-----((?:[^-]|-(?!----))*+)-----END \1-----")
_HEADER = re.compile(r"[A-Za-z0-9-]+: ")
_BODY = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_LINE_ENDS = re.compile(r"\\+[nr]|[\r\n]+")
_ESCAPED = re.compile(r"\\+t|\\+(?=/)|\s")
#: 12 bytes or more; an n after a backslash is a line end.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?<=\\)[nrt])?+([A-Za-z0-9+/_-]{16,}+={0,2})")
#: What a prefix may be glued to.
_PART = re.compile(r"[A-Za-z0-9+/]{16,}+={0,2}")
_BREAK = r"[ \t]*+(?:[\r\n]|\\++[nr])(?:\s|\\++[nrt])*+"
_LINES = re.compile(rf"{_RUN.pattern}(?:{_BREAK}[A-Za-z0-9+/_-]++={{0,2}})++")
_LINE = re.compile(rf"([A-Za-z0-9+/_-]++={{0,2}})(?:{_BREAK})?+")
_OPENSSH = "b3BlbnNzaC1rZXktdjEA"
_PLAIN = re.compile(rb"[\x09-\x7e]*+")
_ANY_HEX = re.compile(r"(?:[0-9A-Fa-f]{2})++")


def _base(text: str) -> list[tuple[int, int, str]]:
    spans = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        spans += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return spans + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def _der_ok(data: bytes, lo: int, hi: int, depth: int = 0) -> bool:
    """Whether bytes lo to hi are whole DER elements whose nested lengths fill them."""
    at, n = lo, 0
    while at < hi:
        if hi - at < 2:
            return False
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            k = size & 0x7F
            if not 0 < k <= 4 or at + k > hi:
                return False
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + size > hi or tag & 0x1F == 0x1F or tag == 0:
            return False
        if tag & 0x20 and depth < 8 and not _der_ok(data, at, at + size, depth + 1):
            return False
        at, n = at + size, n + 1
    return n > 0


def is_key(data: bytes) -> bool:
    """A DER sequence that holds an integer or a sequence and fills the bytes, or an OpenSSH container."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    if len(data) < 16 or data[0] != 0x30 or not _der_ok(data, 0, len(data)):
        return False
    inner = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    first = int.from_bytes(data[2:inner], "big") if inner > 2 else data[1]
    return inner + first == len(data) and data[inner] in (0x02, 0x30)


def _unbase64(run: str) -> bytes:
    bare = run.rstrip("=").translate({45: 43, 95: 47})
    if len(bare) % 4 == 1:
        return b""
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _unhex(run: str) -> bytes:
    return bytes.fromhex(run) if len(run) % 2 == 0 and _ANY_HEX.fullmatch(run) else b""


def _is_header(part: str) -> bool:
    try:
        header = json.loads(_unbase64(part))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _is_text(data: bytes) -> bool:
    return _PLAIN.fullmatch(data) is not None


def _hides(data: bytes) -> str | None:
    """The kind of secret that decoded bytes are, if any."""
    if is_key(data):
        return "key"
    if len(data) >= 12 and _is_text(data):
        text = data.decode("ascii")
        if _base(text) or _confirmed(text):
            return "encoded"
    return None


def _der_size(head: bytes) -> int:
    """Bytes of the DER sequence that starts so, or 0."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    return 0 if k > 4 else 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])


def _joined(lines: list[str], ends: list[int], at: int, decode, bits: int) -> tuple[int, str | None]:
    """Lines from ``at`` on, joined: the line after the last one taken, and the kind of secret if they hide one.

    ``ends`` are the lengths without padding up to each line, ``bits`` what one character stands for.
    """
    first = lines[at].rstrip("=")
    if decode is _unbase64 and first.startswith(_OPENSSH):
        # lines of one width and a last one that may be shorter
        upto = at + 1
        while upto < len(lines) and len(lines[upto]) == len(lines[at]) and lines[upto - 1][-1] != "=":
            upto += 1
        if upto < len(lines) and len(lines[upto]) < len(lines[at]) and lines[upto - 1][-1] != "=":
            upto += 1
        return upto, "key"
    before = ends[at] - len(first)
    if size := _der_size(decode(first[: 48 // bits])):
        # the header tells how long the key is
        last = bisect_left(ends, before + -(-size * 8 // bits), at)
        if last < len(lines) and ends[last] == before + -(-size * 8 // bits) and is_key(decode("".join(lines[at : last + 1]))):
            return last + 1, "key"
    unit, rest, upto = (4 if bits == 6 else 2), "", at
    while upto < len(lines):
        rest += lines[upto].rstrip("=")
        whole = len(rest) // unit * unit
        data = decode(rest[:whole])
        if len(data) * 8 != whole * bits or not _is_text(data):
            break
        rest, upto = rest[whole:], upto + 1
        if lines[upto - 1][-1] == "=":
            break
    # up to three lines of a character each may not make a whole unit
    for end in range(upto, max(at + 1, upto - unit), -1):
        if kind := _hides(decode("".join(lines[at:end]))):
            return end, kind
    return max(upto, at + 1), None


def _wrapped(text: str) -> list[tuple[int, int, str]]:
    """Runs over several lines that hide a secret when they are joined."""
    spans = []
    for m in _LINES.finditer(text):
        found = list(_LINE.finditer(text, m.start(1), m.end()))
        lines = [f[1] for f in found]
        ends = list(accumulate(len(x.rstrip("=")) for x in lines))
        at = 0
        while at < len(lines) - 1:
            after = at + 1
            if len(lines[at]) >= 16:
                for decode, bits in ((_unhex, 4), (_unbase64, 6)):
                    upto, kind = _joined(lines, ends, at, decode, bits)
                    if kind and upto > at + 1:
                        spans.append((found[at].start(1), found[upto - 1].end(1), kind))
                        after = upto
                        break
                    after = max(after, upto)
            at = after
    return spans


def _is_armoured(label: str, inside: str) -> bool:
    """Whether what stands between two armour lines is a key."""
    lines = [line.strip() for line in _LINE_ENDS.split(inside)]
    body = next((i for i, line in enumerate(lines) if line and not _HEADER.match(line)), len(lines))
    joined = _ESCAPED.sub("", "".join(lines[body:]))
    if not _BODY.fullmatch(joined):
        return False
    data = _unbase64(joined)
    if any("ENCRYPTED" in line for line in lines[:body]):
        return label.endswith("PRIVATE KEY") and len(data) >= 16 and len(data) % 8 == 0
    return is_key(data)


def _run_secret(run: str) -> tuple[int, int, str] | None:
    """The part of a run that hides a secret, and its kind: all of it, what follows its first hyphen or underscore, or what stands between two."""
    parts = [(0, len(run))]
    if cuts := [i for i, c in enumerate(run) if c in "-_"]:
        parts += [(cuts[0] + 1, len(run)), *(m.span() for m in _PART.finditer(run))]
    for a, b in parts:
        if b - a >= 16 and (kind := _hides(_unhex(run[a:b])) or _hides(_unbase64(run[a:b]))):
            return a, b, kind
    return None


class _Taken:
    """Spans that were found, to be asked in rising order."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans, self.at, self.reach = sorted(spans), 0, 0

    def holds(self, start: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][0] <= start:
            self.reach = max(self.reach, self.spans[self.at][1])
            self.at += 1
        return start < self.reach


def _confirmed(text: str) -> list[tuple[int, int, str]]:
    spans = []
    if "eyJ" in text:
        spans += [(*m.span(), "token") for m in _SIGNED.finditer(text) if _is_header(m[0].split(".", 1)[0])]
    if "-----BEGIN" in text:
        spans += [(*m.span(), "key") for m in _ARMOUR.finditer(text) if _is_armoured(m[1], m[2])]
    if "\n" in text or "\r" in text or "\\" in text:
        taken = _Taken([s[:2] for s in spans])
        spans += [s for s in _wrapped(text) if not taken.holds(s[0])]
    taken = _Taken([s[:2] for s in spans])
    for m in _RUN.finditer(text):
        if taken.holds(m.start(1)):
            continue
        for group in (1, 0) if m.start(1) > m.start() else (1,):
            if found := _run_secret(m[group]):
                spans.append((m.start(group) + found[0], m.start(group) + found[1], found[2]))
                break
    return spans


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind; none for a null text."""
    if not text:
        return []
    return sorted(_base(text) + _confirmed(text), key=lambda s: (s[0], KINDS.index(s[2])))


def mask_secrets(text: str | None) -> str | None:
    """The text with each run of overlapping secrets replaced by one mark."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at, reach = [], 0, -1
    for start, end, _ in spans:
        if start >= reach:
            out += [text[at:start] if reach < 0 else text[reach:start], MASK]
        reach = max(reach, end)
    return "".join(out) + text[reach:]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found`` (array of start, end, kind) of every row's whole text.

    Null and empty texts have none; repeated rows and null doc_ids are kept; an empty table
    gives no rows; other columns are not read.
    """
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"start": a, "end": b, "kind": k} for a, b, k in find_secrets(t)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "found"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, found array<struct<start:long,end:long,kind:string>>")


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and, if there, ``n_chars`` set to the new length."""
    schema, names = docs.schema, docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(at).to_pylist()
        new = [mask_secrets(t) for t in old]
        columns = list(batch.columns)
        columns[at] = pa.array(new, columns[at].type)
        if "n_chars" in names:
            k = names.index("n_chars")
            counts = [len(b) if b != a else c for a, b, c in zip(old, new, columns[k].to_pylist())]
            columns[k] = pa.array(counts, columns[k].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs, run, schema)
