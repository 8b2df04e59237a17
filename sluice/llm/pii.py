"""Personal data: patterns propose spans, checksums confirm them, context sets the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.common import map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
#: Code points on either side in which context words count.
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_MAYBE_IP = re.compile(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_GROUP = re.compile(r"[A-Z0-9]{1,34}+(?![A-Za-z0-9])")
#: Length of each country's IBANs.
_IBAN_SIZE = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 "
        "GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 "
        "MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 "
        "UA29 VA22 VG24 XK20 YE30"
    ).split()
}

_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
_FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|login|client)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|sms)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|transfer|bic)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|release|build|serial|isbn|example|section)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _base(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", *s) for s in _emails(text)]
    if _MAYBE_IP.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return spans


def _ibans(text: str, start: int) -> list[tuple[int, str]]:
    """Where an IBAN from ``start`` may end, and it without spaces: its country's length first, then the longest."""
    whole, at, ends = "", start, []
    while (m := _GROUP.match(text, at)) and len(whole := whole + m[0]) <= 34:
        if len(whole) >= 15:
            ends.append((m.end(), whole))
        if text[m.end() : m.end() + 1] != " ":
            break
        at = m.end() + 1
    size = _IBAN_SIZE.get(text[start : start + 2])
    return sorted(ends, key=lambda e: (len(e[1]) != size, -e[0]))


def _confirmed(text: str) -> list[tuple[str, int, int]]:
    spans, free = [], 0
    for m in _IBAN.finditer(text):
        if m.start() >= free and (end := next((e for e, whole in _ibans(text, m.start()) if mod97(whole)), None)):
            spans.append(("iban", m.start(), end))
            free = end
    return spans


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    score = _SCORE[kind] + 0.1 * bool(_FOR[kind].search(around)) - 0.3 * bool(_AGAINST.search(around))
    return round(min(1.0, max(0.0, score)), 2)


def find_pii(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind and then start, in code points; none for a null text."""
    if not text:
        return []
    spans = sorted(_base(text) + _confirmed(text), key=lambda s: (KINDS.index(s[0]), s[1]))
    return [(*s, _score(text, *s)) for s in spans]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found`` (array of kind, start, end, score) of every row's whole text.

    Null and empty texts have none; repeated rows and null doc_ids are kept; an empty table
    gives no rows; other columns are not read.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = ("kind", "start", "end", "score")
        found = [[dict(zip(names, s)) for s in find_pii(t)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "found"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>")
