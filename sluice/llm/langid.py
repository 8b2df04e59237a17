"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become TF-IDF vectors of hashed 1- to 3-grams of their lower-case form, at unit
length.  Document frequencies cover every learning row; the weights are fitted on a
bounded sample by follow-the-regularised-leader with elastic-net penalties, and a
temperature fitted on a part of the sample kept apart calibrates the scores.  Executors count
the grams of the sample too: the driver gets counts, at most ``SIZE`` a text, and no texts.
Every language that a learning row has is learnt; what the driver holds, some 0.3 MB each, grows with
their number and with nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import slices

SIZE = 1 << 15
#: Bound of the labelled rows that the weights are fitted on: languages share ``SAMPLE_ROWS`` evenly, but have ``LANGUAGE_ROWS`` each
#: if there are many.  As rows are drawn by chance, up to twice as many may come.
SAMPLE_ROWS = 3000
LANGUAGE_ROWS = 20
UNDETERMINED = "und"

_STEP = 1 << 20
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hash bucket of every 1-, 2- and 3-gram."""
    mixed = [codes * m for m in _MIX]
    for n in (1, 2, 3):
        size = len(codes) - n + 1
        if size > 0:
            h = mixed[0][:size].copy()
            for i in range(1, n):
                h ^= mixed[i][i : i + size]
            h *= np.uint32(0x27D4EB2F + 2 * n)
            yield h >> np.uint32(17)


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    total = np.zeros(SIZE, np.int64)
    for at in range(0, max(1, len(codes)), _STEP):
        part = codes[at : at + _STEP + 2]
        for n, b in enumerate(_buckets(part), 1):
            # a gram belongs to the step in which it starts
            total += np.bincount(b[:_STEP], minlength=SIZE)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class FtrlProximal:
    """Multinomial logistic regression, one weight column a class."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z = np.zeros((SIZE + 1, self.classes), np.float32)
        self.n = np.zeros((SIZE + 1, self.classes), np.float32)

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """``weights`` has a row for each bucket with any weight, ``row_of`` tells which, and its last row is zero."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    row_of: np.ndarray
    temperature: float = 1.0

    @classmethod
    def of(cls, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0) -> "Model":
        used = np.flatnonzero(weights.any(axis=1))
        row_of = np.full(SIZE + 1, len(used), np.int32)
        row_of[used] = np.arange(len(used))
        packed = np.concatenate((weights[used], np.zeros((1, len(languages))))).astype(np.float32)
        return cls(languages, idf, packed, row_of, temperature)

    def logits(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[self.row_of[rows]]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(*vector(*gram_counts(text), self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = ngram_counts(text)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


def vector(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a TF-IDF vector; the last row is constant."""
    values = counts * idf[buckets]
    norm = np.sqrt(values @ values) or 1.0
    return np.append(buckets, SIZE), np.append(values / norm, 0.1)


def pieces(text: str, seed: int) -> list[str]:
    """A text and three short windows of it, so that short texts are learnt too."""
    rng = np.random.default_rng(seed)
    out = [text]
    for n in (8, 24, 80):
        at = int(rng.integers(0, max(1, len(text) - n)))
        if has_letter(piece := text[at : at + n]):
            out.append(piece)
    return out


def fit(rows: list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]], languages: list[str], idf: np.ndarray, epochs: int = 3) -> Model:
    """Fit on (language, gram counts of the pieces) rows; every fifth is kept apart for the temperature."""
    rng = np.random.default_rng(0)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    learner = FtrlProximal(len(languages))
    index = {l: i for i, l in enumerate(languages)}
    vectors = [[(*vector(*c, idf), index[lang]) for c in counts] for lang, counts in rows]
    learn = [v for i, vs in enumerate(vectors) if i % 5 or len(rows) < 20 for v in vs]
    apart = [v for i, vs in enumerate(vectors) if not i % 5 for v in vs]
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            learner.learn(*learn[i])
    model = Model.of(languages, idf, learner.weights())
    if apart:
        logits = np.array([model.logits(r, v) for r, v, _ in apart])
        model.temperature = calibrate(logits, np.array([y for *_, y in apart]))
    return model


def mean_loss(logits: np.ndarray, labels: np.ndarray, temperature: float) -> float:
    return float(-np.log(np.maximum(softmax(logits / temperature)[np.arange(len(labels)), labels], 1e-12)).mean())


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, of a grid from 0.1 to 10, under which the labels are likeliest."""
    return float(min(np.exp(np.linspace(np.log(0.1), np.log(10), 81)), key=lambda t: mean_loss(logits, labels, t)))


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn_model(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows of ``docs`` with text and lang that are not held out.

    A row is held out if crc32 of its doc_id, as text, leaves 2 when divided by 4.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SIZE, np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen += ngram_counts(text) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, total = np.zeros(SIZE), 0
    for r in counted.collect():  # SIZE + 1 rows at most
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1

    by_lang = rows.groupBy("lang").count().collect()
    if not by_lang:
        return Model.of([], idf, np.zeros((SIZE + 1, 0)))
    bound = max(sample_rows, LANGUAGE_ROWS * len(by_lang))
    chances = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, bound / len(by_lang) / r["count"])) for r in by_lang], "lang string, chance double")
    # drawn by the whole row, so that rows without an id are not drawn together, and alike when a task is run again
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).alias("draw")
    drawn = rows.select("text", "lang", draw).join(F.broadcast(chances), "lang").where(F.col("draw") / float(1 << 53) < F.col("chance"))
    # rows that repeat others are drawn with them, but count once
    drawn = drawn.groupBy("draw", "lang").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i in range(batch.num_rows):
                seed, lang, text = (c[i].as_py() for c in batch.columns)
                found = [gram_counts(p) for p in pieces(text, seed)]
                grams, counts = ([f[k].astype(t).tobytes() for f in found] for k, t in ((0, "<u2"), (1, "<u4")))
                yield pa.RecordBatch.from_pylist([{"draw": seed, "lang": lang, "grams": grams, "counts": counts}], schema=schema)

    schema = pa.schema([("draw", pa.int64()), ("lang", pa.string()), ("grams", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])
    counted = drawn.mapInArrow(count, "draw long, lang string, grams array<binary>, counts array<binary>")
    sample = counted.orderBy("draw", "lang").limit(2 * bound).collect()
    vectors = [(r["lang"], [(np.frombuffer(g, "<u2").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64)) for g, c in zip(r["grams"], r["counts"])]) for r in sample]
    return fit(vectors, sorted(r["lang"] for r in by_lang), idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row's whole text.

    A text that is null or has no letter is ``und`` with score zero, and so is every text if
    nothing could be learnt.  Repeated rows and null doc_ids (never held out) are kept; an empty table
    gives no rows; only text is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], langs, scores], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns; ``lang`` says which.

    It is the one predicted from the whole text, if with ``min_score`` or more, else the one that the row came
    with.  Rows with neither go, and so do those whose text is null or has no letter.
    """
    names, at, lang_at = docs.columns, docs.columns.index("text"), docs.columns.index("lang")

    def language(text: str | None, given: str | None) -> str | None:
        lang, score = model.predict(text)
        if lang == UNDETERMINED or score < min_score:
            lang = given if has_letter(text) else None
        return None if lang == UNDETERMINED else lang

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [language(t, g) for t, g in zip(batch.column(at).to_pylist(), batch.column(lang_at).to_pylist())]
            columns = list(batch.columns)
            columns[lang_at] = pa.array(found, columns[lang_at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(columns[lang_at].is_valid())

    return docs.mapInArrow(run, docs.schema)
