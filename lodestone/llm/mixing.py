"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A multinomial classifier over hashed character trigrams is trained on all rows of the labelled
table (counts added up in Spark) and gives every document a posterior over domains. Rates r >= 0
minimise half the squared distance between the expected totals sum r n p_k and the targets w_k T by
projected gradient steps: each step is one distributed sum of as many numbers as there are
domains, and every document moves by its own posterior. Steps stop after ROUNDS or when the totals
are within TOLERANCE.

Defined results: null or empty text has no tokens and rate 1; labelled rows with a null domain
train nothing; if no labelled row has a domain, every rate is 1; equal rows get equal rates.
"""

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pieces_of, semi, small_batches

#: Hashed features, domains at most, and how many n-grams' worth of evidence a document counts for.
FEATURES = 1 << 14
DOMAINS = 256
EVIDENCE = 24.0
ROUNDS = 40
TOLERANCE = 1e-4

#: Production weights of the language domains, relative to each other; a domain without one keeps its share of the corpus.
TARGETS = {"en": 0.52, "de": 0.18, "fr": 0.17, "es": 0.13}


def features(text: str) -> np.ndarray:
    """Counts of hashed, case-folded character trigrams."""
    s = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(s) < 3:
        return np.zeros(FEATURES, np.int64)
    h = (s[:-2] * np.uint64(0x9E3779B1) + s[1:-1] * np.uint64(0x85EBCA77) + s[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((h >> np.uint64(50)).astype(np.int64), minlength=FEATURES)


def _count(batches):
    """Sums of a task's labelled documents, once for each domain."""
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for pdf in batches:
        for d, t in zip(pdf["domain"], pdf["text"], strict=True):
            if d in sums:
                sums[d] += features(t or "")
                rows[d] += 1
            else:
                sums[d], rows[d] = features(t or ""), 1
    for d, c in sums.items():
        at = np.nonzero(c)[0]
        yield pd.DataFrame({"domain": d, "f": np.append(at, -1), "c": np.append(c[at], rows[d])})


class Classifier:
    """Log likelihoods of features by domain; a few megabytes at most (DOMAINS x FEATURES)."""

    def __init__(self, counts: pd.DataFrame):
        self.domains = sorted(counts["domain"].unique())
        at = {d: i for i, d in enumerate(self.domains)}
        c, prior = np.zeros((len(at), FEATURES)), np.zeros(len(at))
        for d, f, n in counts.itertuples(index=False):
            if f < 0:
                prior[at[d]] = n
            else:
                c[at[d], f] = n
        c += 0.1
        self.weights = (np.log(c / c.sum(1, keepdims=True))).astype(np.float32)
        self.prior = np.log(prior / prior.sum())

    def posterior(self, text: str) -> np.ndarray:
        f = features(text)
        at = np.nonzero(f)[0]
        n = f[at].sum()
        logit = self.prior + (self.weights[:, at] @ f[at]) * (min(n, EVIDENCE) / n if n else 0)
        p = np.exp(logit - logit.max())
        return p / p.sum()


def train(labelled: DataFrame) -> Classifier | None:
    """labelled: (domain, text). At most DOMAINS x FEATURES sums reach the driver."""
    sums = keep(labelled.filter(F.col("domain").isNotNull()).select("domain", "text").mapInPandas(_count, "domain string, f int, c long")
                .groupBy("domain", "f").agg(F.sum("c").alias("c")), "sums")
    domains = sums.select("domain").distinct().count()
    if domains > DOMAINS:
        raise ValueError(f"{domains} domains; at most {DOMAINS} are supported")
    return Classifier(sums.toPandas()) if domains else None


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, mark, row, n_tokens, p): posteriors and tokens (words) of each document row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in pieces_of(batches, lambda r: len(r.text or ""), 4 << 20):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "mark": pdf["mark"], "row": pdf["row"],
                                "n_tokens": [len((t or "").split()) for t in pdf["text"]],
                                "p": [held.value.posterior(t or "") for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"),
                       F.monotonically_increasing_id().alias("row"), "text")
    return keep(rows.mapInPandas(run, "doc_id long, mark long, row long, n_tokens long, p array<double>"), "posteriors")


def _walk(p: np.ndarray, history) -> np.ndarray:
    """Each document's rate after the gradient steps so far, projected onto r >= 0 at each."""
    r = np.ones(len(p))
    for step in history:
        r = np.maximum(0.0, r - p @ step)
    return r


def _sums(soft: DataFrame, history) -> np.ndarray:
    def run(batches):
        total = 0
        for pdf in batches:
            if len(pdf):
                p = np.stack(pdf["p"].to_numpy())
                total = total + (_walk(p, history) * pdf["n_tokens"].to_numpy()) @ p
        if not np.isscalar(total):
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    rows = soft.select("n_tokens", "p").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["k"])])


def fit(soft: DataFrame, weights: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The gradient steps: with errors e_k = (totals - targets) / T, each document moves by -p . A e.

    A is the inverse of the domains' second moments sum n p p' / T (plus a little), so that a step would
    reach the targets if no rate were cut at zero.
    """
    def second(batches):
        total = 0
        for pdf in batches:
            if len(pdf):
                p = np.stack(pdf["p"].to_numpy())
                total = total + (p * pdf["n_tokens"].to_numpy()[:, None]).T @ p
        if not np.isscalar(total):
            yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

    rows = soft.select("n_tokens", "p").mapInPandas(second, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return []
    moments = np.array([r["v"] for r in sorted(rows, key=lambda r: r["k"])]).reshape(len(weights), -1)
    total = moments.sum()
    if total <= 0:
        return []
    moments /= total
    # Domains that the classifier cannot tell apart share a direction; the ridge keeps it bounded.
    gain = np.linalg.inv(moments + 1e-3 * np.trace(moments) / len(weights) * np.eye(len(weights)))
    history: list[np.ndarray] = []
    for _ in range(rounds):
        error = _sums(soft, history) / total - weights
        if np.abs(error).max() <= TOLERANCE:
            break
        history.append(gain @ error)
    return history


def shares(soft: DataFrame, model: Classifier, targets: Mapping[str, float]) -> np.ndarray:
    """The weight of each domain; they sum to 1."""
    given = np.array([targets.get(d, np.nan) for d in model.domains], float)
    rest = np.isnan(given)
    if not rest.any() and given.sum() > 0:
        return given / given.sum()
    now = _sums(soft, [])
    now = now / now.sum() if now.sum() > 0 else np.exp(model.prior)
    weights, listed = now.copy(), given[~rest].sum()
    weights[~rest] = given[~rest] * (now[~rest].sum() / listed) if listed > 0 else 0.0
    if weights.sum() <= 0:
        return now
    return weights / weights.sum()


def rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] | None = None) -> DataFrame:
    """doc_id, mark, row, n_tokens, domain, p_domain, rate, copies for each document row.

    labelled: (domain, text). targets: weight by domain, relative to each other; a domain without one keeps
    its share of the tokens of docs, and the others divide what is left.
    copies is the rate rounded up or down by a hash of the row's key, so that its expectation is the rate.
    """
    small_batches(docs.sparkSession)
    model = train(labelled)
    if model is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"),
                           F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long").alias("n_tokens"))
        return rows.select("*", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("p_domain"),
                           F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    soft = posteriors(docs, model)
    weights = shares(soft, model, targets or {})
    history = fit(soft, weights)
    names = model.domains

    def run(batches):
        for pdf in batches:
            if len(pdf):
                p = np.stack(pdf["p"].to_numpy())
                r = np.where(pdf["n_tokens"].to_numpy() > 0, _walk(p, history), 1.0)
                yield pdf.drop(columns="p").assign(
                    doc_id=pdf["doc_id"].astype("Int64"), domain=[names[i] for i in p.argmax(1)], p_domain=p.max(1), rate=r)

    out = soft.mapInPandas(run, "doc_id long, mark long, row long, n_tokens long, domain string, p_domain double, rate double")
    chance = F.pmod(F.xxhash64("doc_id", "mark", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(domain, text) of the documents that the labelled table holds; the domain is the language."""
    ids = labels.filter(F.col("quality") == 1).select("doc_id")
    return semi(docs.select("doc_id", F.col("lang").alias("domain"), "text"), ids)


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] | None = None) -> DataFrame:
    """The documents, each as often as its copies."""
    found = rates(docs, labelled, targets).select(F.col("doc_id").alias("key"), F.col("mark").alias("key_mark"), "copies")
    found = found.dropDuplicates(["key", "key_mark"])
    # The document is one struct, so that its columns cannot clash with the keys.
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"))
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("key")) & (F.col("mark") == F.col("key_mark"))).filter("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
