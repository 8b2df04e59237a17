import math
from collections import Counter

import numpy as np

from sluice.llm import langid as L

SETS = {"aa": "kala mora tilu sana", "bb": "über schön grüße straße", "cc": "ñandú acción según año"}


def _rows(n=240):
    rng = np.random.default_rng(0)
    langs = sorted(SETS)
    return [(i, " ".join(rng.choice(SETS[langs[i % 3]].split(), int(rng.integers(1, 40)))), langs[i % 3]) for i in range(n)]


def test_counts_cover_the_whole_text(monkeypatch):
    text = "Añb cde " * 50
    whole = L.ngram_counts(text)
    monkeypatch.setattr(L, "_STEP", 37)
    assert (L.ngram_counts(text) == whole).all()
    assert whole.sum() == 3 * len(text) - 3
    assert L.ngram_counts("").sum() == 0


def test_held_out_accuracy_and_edges(spark):
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, "kala", None), (None, "mora", "aa"), (None, "mora", "aa"), (904, "x" * 3_000_000, None)]
    df = spark.createDataFrame([(*r, 1) for r in _rows() + odd], "doc_id long, text string, lang string, score int")
    model = L.learn_model(df)
    got = L.predict(df, model).collect()
    assert len(got) == 247
    want = {r[0]: r[2] for r in _rows()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 30 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {900, 901, 902}
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == 244


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.predict(df, L.learn_model(df)).collect()] == [("und", 0.0)] * 2
    empty = df.limit(0)
    assert L.predict(empty, L.learn_model(empty)).count() == 0


def test_the_language_kept_is_the_one_the_text_shows(spark):
    weights = np.zeros((L.SIZE + 1, 3))
    for k, word in enumerate(("kala", "über", "ñandú")):
        weights[np.flatnonzero(L.ngram_counts(word)), k] = 50.0
    model = L.Model.of(["aa", "bb", L.UNDETERMINED], np.ones(L.SIZE), weights)
    rows = [
        (1, "kala", "bb", "aa"),
        (2, "über", None, "bb"),
        # no gram that was learnt: a third for each
        (3, "жщю", "ru", "ru"),
        (4, "жщю", None, None),
        (5, "жщю", L.UNDETERMINED, None),
        # shows the label that says there is none
        (6, "ñandú", "aa", "aa"),
        (7, "ñandú", None, None),
        (8, "12 !", "aa", None),
        (9, None, "aa", None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in L.keep_identified(df, model, 0.5).collect()}
    assert got == {r[0]: r[3] for r in rows if r[3]}


def test_elastic_net_makes_weights_sparse():
    rng = np.random.default_rng(1)
    learner = L.FtrlProximal(2, l1=0.5)
    for i in range(200):
        noise = rng.integers(10, L.SIZE, 20)
        learner.learn(np.append(np.unique(noise), L.SIZE), np.append(np.full(len(np.unique(noise)), 0.1), float(i % 2)), i % 2)
    assert (learner.weights() == 0).mean() > 0.9


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(4)
    letters = [chr(0x61 + i) for i in range(26)] + [chr(0x3B1 + i) for i in range(17)]
    words = {f"l{k:03d}": ["".join(rng.choice(letters, 6)) for _ in range(6)] for k in range(200)}
    rows = [(i, " ".join(rng.choice(words[f"l{i % 200:03d}"], 12)), f"l{i % 200:03d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn_model(df, sample_rows=100)
    assert model.languages == sorted(words)
    got = L.predict(df, model).where("held_out").collect()
    assert len(got) > 500 and np.mean([r.lang_pred == f"l{r.doc_id % 200:03d}" for r in got]) > 0.9


def test_the_driver_gets_counts_of_very_long_texts(spark):
    rows = [(i, (SETS[l] + " ") * 60_000, l) for i, l in enumerate(sorted(SETS) * 8)] + [(None, "kala tilu", "aa")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn_model(df)
    assert [model.predict(SETS[l])[0] for l in sorted(SETS)] == sorted(SETS)


class _PlainFtrl:
    """The update as it is written in the literature, one weight at a time."""

    def __init__(self, like):
        self.like, self.z, self.n = like, {}, {}

    def weight(self, i, c):
        z, n, f = self.z.get((i, c), 0.0), self.n.get((i, c), 0.0), self.like
        if abs(z) <= f.l1:
            return 0.0
        return -(z - math.copysign(f.l1, z)) / ((f.beta + math.sqrt(n)) / f.alpha + f.l2)

    def learn(self, rows, values, label):
        w = {(i, c): self.weight(i, c) for i in rows for c in range(self.like.classes)}
        logits = [sum(v * w[i, c] for i, v in zip(rows, values)) for c in range(self.like.classes)]
        e = [math.exp(x - max(logits)) for x in logits]
        for c in range(self.like.classes):
            d = e[c] / sum(e) - (c == label)
            for i, v in zip(rows, values):
                g, n = v * d, self.n.get((i, c), 0.0)
                self.z[i, c] = self.z.get((i, c), 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.like.alpha * w[i, c]
                self.n[i, c] = n + g * g


def test_the_learner_against_a_plain_one():
    rng = np.random.default_rng(2)
    learner = L.FtrlProximal(3)
    plain = _PlainFtrl(learner)
    for _ in range(120):
        rows = np.sort(rng.choice(30, 6, replace=False))
        values = rng.random(6)
        label = int(rows[0] % 3)
        learner.learn(rows, values, label)
        plain.learn(rows.tolist(), values.tolist(), label)
    got = learner.weights()
    assert all(abs(got[i, c] - plain.weight(i, c)) < 1e-3 for i in range(30) for c in range(3)) and np.abs(got).max() > 0.1


def test_vectors_and_predictions_against_plain_ones(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string, lang string")
    model = L.learn_model(df)
    dense = model.weights[model.row_of].astype(np.float64)
    for text in ("Kala mora", "über STRASSE x", "acción 12"):
        counts = Counter()
        codes = [ord(c) for c in text.lower()]
        for n in (1, 2, 3):
            for i in range(len(codes) - n + 1):
                h = 0
                for k in range(n):
                    h ^= codes[i + k] * int(L._MIX[k]) & 0xFFFFFFFF
                counts[(h * (0x27D4EB2F + 2 * n) & 0xFFFFFFFF) >> 17] += 1
        tfidf = {b: c * model.idf[b] for b, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in tfidf.values()))
        logits = [sum(v / norm * dense[b, c] for b, v in tfidf.items()) + 0.1 * dense[L.SIZE, c] for c in range(3)]
        e = [math.exp(x / model.temperature) for x in logits]
        best = max(range(3), key=lambda c: e[c])
        lang, score = model.predict(text)
        assert lang == model.languages[best] and abs(score - e[best] / sum(e)) < 1e-4


def test_the_temperature_calibrates():
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 3, 4000)
    # logits thrice as bold as the labels deserve
    honest = rng.standard_normal((4000, 3)) + 1.5 * np.eye(3)[labels]
    honest = np.log(L.softmax(1.5 * honest))
    drawn = np.array([rng.choice(3, p=p) for p in L.softmax(honest)])
    t = L.calibrate(3 * honest, drawn)
    assert 2.4 < t < 3.7 and L.mean_loss(3 * honest, drawn, t) < L.mean_loss(3 * honest, drawn, 1.0)
