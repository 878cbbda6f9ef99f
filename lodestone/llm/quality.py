"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model has character n-grams of order 4, counted over the trusted documents (labelled good and
not toxic). Count tables are joined order by order to a probability for every n-gram type of the
corpus. For scoring, a task packs the n-gram counts of a batch of documents by shard of the n-gram;
each packed part meets its shard of the probabilities, and the partial sums of a batch are added.
A document is rejected if its smoothed perplexity is above its language's quantile over trusted
documents that were held out of training, times a margin.

Defined results: null or empty text is scored as an empty document and kept; a null language is
its own language; a language with few trusted documents takes the threshold over all; repeated rows
are scored alike; without any trusted document every row is kept, with null perplexity.
"""

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, partitions, pieces_of, semi, small_batches

ORDER = 4
BITS = 10
#: Shards of the model; a document batch sends one packed row to each.
SHARDS = 16
#: A language's threshold: this quantile of its held-out trusted documents' perplexity, times the margin.
QUANTILE, MARGIN, LEAST = 0.99, 1.1, 10
#: One in so many trusted documents sets thresholds instead of training.
HELD = 6
#: Symbols at the language's average that are added to each document, so that short ones are not rejected by chance.
PRIOR = 150


def symbols(text: str) -> np.ndarray:
    """Code points below 592 as they are, blocks of 128 for the rest; digits and white space are folded."""
    s = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    s = np.where(s < 592, s, 592 + (s >> 7) % 432)
    s[(s >= 48) & (s <= 57)] = 48
    s[(s == 9) | (s == 10) | (s == 13)] = 32
    return s


def grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """(document position, n-gram code) of all n-grams, with start and end marks."""
    start, end = np.full(ORDER - 1, 1), np.array([2])
    parts, sizes = [], []
    for t in texts:
        s = symbols(t)
        parts += [start, s, end]
        sizes.append(len(s) + ORDER)
    s = np.concatenate(parts)
    code = s[ORDER - 1:].copy()
    for i in range(1, ORDER):
        code |= s[ORDER - 1 - i:len(s) - i] << (BITS * i)
    doc = np.repeat(np.arange(len(sizes)), sizes)[ORDER - 1:]
    inside = np.ones(len(code), bool)
    ends = np.cumsum(sizes)[:-1]
    for i in range(ORDER - 1):  # n-grams that start in one document and end in the next
        inside[ends - (ORDER - 1) + i] = False
    return doc[inside], code[inside]


def _texts(pdf):
    return [t or "" for t in pdf["text"]]


def _count(batches):
    for pdf in pieces_of(batches, lambda r: len(r.text or "")):
        g, c = np.unique(grams(_texts(pdf))[1], return_counts=True)
        yield pd.DataFrame({"g": g, "c": c})


def _types(batches):
    seen = np.zeros(0, np.int64)
    for pdf in pieces_of(batches, lambda r: len(r.text or "")):
        new = np.setdiff1d(np.unique(grams(_texts(pdf))[1]), seen, assume_unique=True)
        seen = np.union1d(seen, new)
        if len(seen) > 4_000_000:
            seen = np.zeros(0, np.int64)
        yield pd.DataFrame({"g": new})


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame, list[float]]]:
    """For each order from 1: counts (g, c), contexts (u, total, gamma), discounts."""
    counts = keep(trusted.select("text").mapInPandas(_count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")), "counts")
    tables = [counts]
    for n in range(ORDER - 1, 0, -1):
        mask = (1 << (BITS * n)) - 1
        tables.append(keep(tables[-1].groupBy(F.col("g").bitwiseAND(mask).alias("g")).agg(F.count("*").alias("c")), f"order{n}"))
    model = []
    for t in reversed(tables):
        few = {r["c"]: r["n"] for r in t.filter("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        n1, n2, n3, n4 = (few.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = t.groupBy(F.shiftright("g", BITS).alias("u")).agg(
            F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("gamma"))
        model.append((t, keep(contexts, "contexts"), d))
    return model


def probabilities(model, types: DataFrame) -> DataFrame:
    """(g, lp): the log probability of the last symbol of each n-gram type given those before it."""
    lower = None
    for n, (t, contexts, d) in enumerate(model, 1):
        mask = (1 << (BITS * n)) - 1
        asked = types.select(F.col("g").bitwiseAND(mask).alias("g")).distinct() if n < ORDER else types
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        x = asked.join(t, "g", "left").withColumn("u", F.shiftright("g", BITS)).join(contexts, "u", "left")
        own = F.coalesce((F.col("c") - cut) / F.col("total"), F.lit(0.0))
        gamma = F.coalesce("gamma", F.lit(1.0))
        if lower is None:
            x = x.select("g", (own + gamma / (1 << BITS)).alias("p"))
        else:
            x = x.withColumn("low", F.col("g").bitwiseAND((1 << (BITS * (n - 1))) - 1))
            x = x.join(lower.withColumnsRenamed({"g": "low", "p": "lp"}), "low").select("g", (own + gamma * F.col("lp")).alias("p"))
        lower = keep(x, f"p{n}")
    return lower.select("g", F.log("p").alias("lp"))


def _pack(batches):
    """A row for each batch and shard: sorted n-grams, documents and counts, compressed."""
    import zstandard
    from pyspark import TaskContext

    part, made, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
    for pdf in pieces_of(batches, lambda r: len(r.text or ""), 2 << 20):
        doc, code = grams(_texts(pdf))
        key, count = np.unique((code << 16) | doc, return_counts=True)
        code, doc = key >> 16, (key & 0xFFFF).astype(np.uint16)
        shard = code % SHARDS
        made += 1
        head = json.dumps([[None if pd.isna(i) else int(i), lang, len(t or "")] for i, lang, t in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True)])
        rows = []
        for s in range(SHARDS):
            at = shard == s
            g, n = np.unique(code[at], return_counts=True)
            data = b"".join(x.tobytes() for x in (np.diff(g, prepend=0), n.astype(np.uint16), doc[at], count[at].astype(np.uint32)))
            rows.append((f"{part}-{made}", s, made, len(g), len(pdf), press.compress(data), head if s == 0 else None))
        yield pd.DataFrame(rows, columns=["batch", "shard", "turn", "n", "docs", "data", "head"])


def _shards(key, pdf):
    pdf = pdf.sort_values("g")
    return pd.DataFrame([(key[0], pdf["g"].to_numpy(np.int64).tobytes(), pdf["lp"].to_numpy(np.float64).tobytes())], columns=["shard", "gs", "lps"])


def _sum(batches):
    import zstandard

    press = zstandard.ZstdDecompressor()
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            data, n = press.decompress(r.data), r.n
            g = np.cumsum(np.frombuffer(data, np.int64, n))
            each = np.frombuffer(data, np.uint16, n, 8 * n)
            total = int(each.sum())
            doc = np.frombuffer(data, np.uint16, total, 10 * n)
            count = np.frombuffer(data, np.uint32, total, 10 * n + 2 * total)
            lp = np.frombuffer(r.lps)[np.searchsorted(np.frombuffer(r.gs, np.int64), g)] if n else np.zeros(0)
            sums = np.bincount(doc, np.repeat(lp, each) * count, r.docs) if total else np.zeros(r.docs)
            out.append((r.batch, sums.tobytes(), r.head))
        yield pd.DataFrame(out, columns=["batch", "sums", "head"])


def _unpack(pdf):
    sums = np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0)
    head = json.loads(next(h for h in pdf["head"] if h))
    return pd.DataFrame([(i, lang, n + 1, s) for (i, lang, n), s in zip(head, sums, strict=True)],
                        columns=["doc_id", "lang", "n_symbols", "lp"]).astype({"doc_id": "Int64"})


def logs(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, n_symbols, lp): each row's log likelihood under the model of the trusted texts."""
    spark = docs.sparkSession
    lp = probabilities(train(trusted), keep(docs.select("text").mapInPandas(_types, "g long").distinct(), "types"))
    salts = max(1, partitions(spark) // SHARDS)
    shards = lp.withColumn("shard", (F.col("g") % SHARDS).cast("int")).groupBy("shard").applyInPandas(_shards, "shard int, gs binary, lps binary")
    shards = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    packed = docs.select("doc_id", "lang", "text").mapInPandas(
        _pack, "batch string, shard int, turn int, n int, docs int, data binary, head string")
    packed = packed.withColumn("salt", F.pmod(F.hash("batch"), F.lit(salts)))
    sums = packed.join(keep(shards, "shards"), ["shard", "salt"]).select("batch", "n", "docs", "data", "head", "gs", "lps")
    sums = sums.mapInPandas(_sum, "batch string, sums binary, head string")
    return sums.groupBy("batch").applyInPandas(_unpack, "doc_id long, lang string, n_symbols long, lp double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, adjusted, threshold, keep for each document row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("doc_id"))
    if good.isEmpty():
        return docs.select(
            "doc_id", "lang", (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("n_symbols"),
            *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "adjusted", "threshold")], F.lit(True).alias("keep"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0
    scored = keep(logs(docs, semi(docs, good.filter(~held))), "scored")
    known = scored.join(good.filter(held).distinct(), "doc_id", "left_semi")
    means = known.groupBy("lang").agg((F.sum("lp") / F.sum("n_symbols")).alias("mean"), F.count("*").alias("n"))
    every = known.agg((F.sum("lp") / F.sum("n_symbols")).alias("mean_all"))
    means = means.crossJoin(F.broadcast(every))  # one row

    def adjusted(rows):
        rows = rows.join(keep_means, rows["lang"].eqNullSafe(keep_means["l"]), "left")
        mean = F.when(F.col("n") >= LEAST, F.col("mean")).otherwise(F.lit(overall))
        return rows.withColumn("adjusted", F.exp(-(F.col("lp") + PRIOR * mean) / (F.col("n_symbols") + PRIOR)))

    overall = every.first()["mean_all"]
    if overall is None:
        overall = -math.log(1 << BITS)
    keep_means = keep(means.select(F.col("lang").alias("l"), "mean", "n"), "means")
    limits = adjusted(known).withColumn("few", F.coalesce(F.col("n") < LEAST, F.lit(True)))
    own = limits.groupBy(F.col("lang").alias("tl"), "few").agg(F.percentile_approx("adjusted", quantile, 10_000).alias("at"))
    overall_at = limits.agg(F.percentile_approx("adjusted", quantile, 10_000).alias("at")).first()["at"]
    own = keep(own.filter(~F.col("few")).drop("few"), "limits")
    rows = adjusted(scored)
    rows = rows.join(own, rows["lang"].eqNullSafe(own["tl"]), "left")
    rows = rows.withColumn("threshold", margin * F.coalesce("at", F.lit(overall_at), F.lit(float("inf"))))
    return rows.select("doc_id", "lang", "n_symbols", F.exp(-F.col("lp") / F.col("n_symbols")).alias("perplexity"), "adjusted", "threshold",
                       ((F.col("n_symbols") <= 1) | (F.col("adjusted") <= F.col("threshold"))).alias("keep"))
