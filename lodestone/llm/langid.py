"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are the 2- to 4-grams of characters inside words, word borders included, hashed into BUCKETS
rows of an embedding table. A text is the mean of its subwords' embeddings; a linear softmax over the
learned languages follows. Both are trained by stochastic gradient descent in numpy on at most SAMPLE
labelled texts (the smallest by a hash of text, equally many for each language at most), each gathered
as its bucket counts. Every fifth sampled text is kept from the fit and calibrates it: a temperature
that makes scores probabilities, and the score below which a prediction is rejected.

The model is a bounded table that every task has; texts are read whole, CHARS characters at a time.

Defined results: null texts and those without a letter are `und` with score 0 and rejected; without any
labelled text every prediction is; a null doc_id is not held out; rows with a null lang teach nothing;
ties of languages go to the smaller; repeated rows are predicted alike; other columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, pieces_of, scope

BUCKETS = 1 << 14
WIDTH = 16
GRAMS = (2, 3, 4)
#: Labelled texts that the model is fitted on, at most: BUCKETS counts each bound what the driver holds.
SAMPLE = 2048
#: Characters of a text that are looked at together.
CHARS = 1 << 20
EPOCHS, BATCH, RATE = 12, 32, 0.5
#: Half the lessons are so many subwords of a text, so that short texts are learned as well.
SHORT = (5, 100)
#: Share of right predictions of the calibration texts that rejection may cost.
LOSS = 0.005
UNKNOWN = "und"
#: Documents whose doc_id has this remainder teach nothing.
PARTS, HELD = 4, 2

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Subwords:
    """Bucket counts of texts."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def counts(self, text: str) -> np.ndarray:
        total, tail = np.zeros(BUCKETS, np.int64), np.zeros(1, np.uint32)  # a text begins with a border
        for a in range(0, len(text), CHARS):
            part = text[a:a + CHARS]
            last = a + CHARS >= len(text)
            s = np.frombuffer(part.lower().encode("utf-32-le", "replace"), np.uint32)
            s = np.where(self.letter[np.minimum(s, 0x10FFFF)], s, 0)
            s = np.concatenate([tail, s, np.zeros(1 if last else 0, np.uint32)])
            fresh = np.ones(len(s), bool)  # runs of other characters are one border
            fresh[1:] = (s[1:] != 0) | (s[:-1] != 0)
            fresh[:len(tail)] = True
            new = len(tail)
            s = s[fresh]
            x = s.astype(np.uint64) + np.uint64(1)
            for n in GRAMS:
                first = max(0, new - n + 1)  # grams that end in this part
                m = len(s) - n + 1 - first
                if m <= 0:
                    continue
                h = np.full(m, n, np.uint64)
                inside = np.ones(m, bool)
                for k in range(n):
                    h += x[first + k:first + k + m] * _MULT[k]
                    if 0 < k < n - 1:
                        inside &= s[first + k:first + k + m] != 0
                if n == 2:  # a border and a letter, or two letters
                    inside &= (s[first:first + m] != 0) | (s[first + 1:first + 1 + m] != 0)
                total += np.bincount((mix64(h[inside]) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
            tail = s[-(max(GRAMS) - 1):]
        return total


def _gathered(batches):
    words = Subwords()
    for pdf in pieces_of(batches, lambda r: len(r.text)):
        for r in pdf.itertuples(index=False):
            c = words.counts(r.text)
            at = np.nonzero(c)[0]
            yield pd.DataFrame({"lang": [r.lang], "place": [r.place], "at": [at.astype(np.int16).tobytes()], "n": [c[at].astype(np.float32).tobytes()]})


def sample(docs: DataFrame, most: int = SAMPLE) -> list:
    """At most `most` rows (lang, place, at, n): bucket counts of labelled texts, languages in equal parts."""
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % PARTS
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc != HELD))
    # Equal texts are one lesson; a place by hash does not depend on the order of rows.
    rows = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    names = rows.select("lang").distinct().orderBy(F.xxhash64("lang"), "lang").limit(most)
    w = Window.partitionBy("lang").orderBy("h")
    ids = rows.select("lang", "h").distinct().withColumn("place", F.row_number().over(w))
    each = F.greatest(F.lit(1), F.floor(F.lit(most) / F.greatest(F.lit(1), F.col("langs"))))
    ids = ids.filter(F.col("place") <= most).join(F.broadcast(names), "lang")  # at most `most` names
    ids = ids.crossJoin(F.broadcast(names.agg(F.count("*").alias("langs")))).filter(F.col("place") <= each)
    picked = rows.join(F.broadcast(ids.drop("langs")), ["lang", "h"]).dropDuplicates(["lang", "place"])  # at most `most` keys
    return picked.select("lang", "place", "text").mapInPandas(_gathered, "lang string, place int, at binary, n binary").collect()


def _dense(rows, g: np.random.Generator, short: float) -> np.ndarray:
    """A row of shares for each text; for a part `short` of them only a few subwords, drawn at random."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        n = np.frombuffer(r["n"], np.float32).astype(np.float64)
        if g.random() < short:
            n = g.multinomial(int(np.exp(g.uniform(*np.log(SHORT)))), n / n.sum())
        x[i, np.frombuffer(r["at"], np.int16)] = n / n.sum()
    return x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def level(mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means at one length, and their lengths: means of many subwords are short."""
    size = np.sqrt((mean * mean).mean(1, keepdims=True)) + 1e-9
    return mean / size, size


class Model:
    """Languages, embeddings, softmax weights and bias, a temperature and the least score that is not rejected."""

    def __init__(self, langs, table, w, b, heat=1.0, least=0.0):
        self.langs, self.table, self.w, self.b, self.heat, self.least = langs, table, w, b, heat, least

    def logits(self, x: np.ndarray) -> np.ndarray:
        return level(x @ self.table)[0] @ self.w + self.b

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        at = np.nonzero(counts)[0]
        mean = counts[at] @ self.table[at] / counts.sum()
        p = softmax((level(mean[None])[0] @ self.w + self.b) / self.heat)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit(rows) -> Model | None:
    rows = sorted(rows, key=lambda r: (r["lang"], r["place"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    calm = [r for r in rows if r["place"] % 5 == 0]
    rows = [r for r in rows if r["place"] % 5]
    y = np.array([langs.index(r["lang"]) for r in rows])
    g = np.random.default_rng(5)
    table = g.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32)
    w, b = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, done = EPOCHS * -(-len(rows) // BATCH), 0
    for _ in range(EPOCHS):
        order = g.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            at = order[a:a + BATCH]
            rate = RATE * (1 - done / steps)
            x = _dense([rows[i] for i in at], g, 0.5)
            mean, size = level(x @ table)
            p = softmax(mean @ w + b)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = p @ w.T / size
            w -= rate * mean.T @ p
            b -= rate * p.sum(0)
            table -= rate * (x.T @ back)
            done += 1
    model = Model(langs, table.astype(np.float64), w.astype(np.float64), b.astype(np.float64))
    if calm:
        x = np.concatenate([_dense(calm, g, 0), _dense(calm, g, 1)])
        calibrate(model, x.astype(np.float64), np.array([langs.index(r["lang"]) for r in calm] * 2))
    return model


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature of least log loss, and the score that all but LOSS of the right predictions reach.

    Targets are a little below 1, as if one more text had been mistaken: finite scores whatever the sample.
    """
    z, k = model.logits(x), len(model.langs)
    want = np.full(z.shape, 1 / (len(y) + k))
    want[np.arange(len(y)), y] += len(y) / (len(y) + k)
    heats = np.geomspace(1e-2, 1e2, 201)
    model.heat = float(min(heats, key=lambda t: -(want * np.log(softmax(z / t) + 1e-12)).sum(1).mean()))
    p = softmax(z / model.heat)
    right = p.argmax(1) == y
    if right.any():
        model.least = float(np.quantile(p.max(1)[right], LOSS, method="lower"))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for each document row."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of WIDTH numbers

    def run(batches):
        words, model = Subwords(), known.value
        for pdf in pieces_of(batches, lambda r: len(r.text or "")):
            out = []
            for t in pdf["text"]:
                counts = words.counts(t) if t and model else np.zeros(1)
                out.append(model.predict(counts) if counts.any() else (UNKNOWN, 0.0))
            lang, score = zip(*out, strict=True)
            score = np.array(score)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": lang, "score": score,
                                "rejected": (np.array(lang, object) == UNKNOWN) | (score < (model.least if model else 1))})

    doc_id = F.col("doc_id").cast("long").cast("string")
    held = F.coalesce(F.crc32(doc_id.cast("binary")) % PARTS == HELD, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), held.alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double, rejected boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def identify(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The model fitted on the labelled part of `docs`, and its predictions for all of them."""
    spark = docs.sparkSession
    with scope(spark, batch=1000) as kept:
        return kept.result(predict(docs, fit(sample(docs, most))))
