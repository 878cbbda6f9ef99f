"""Ranking columns: exact names, identity coverage, authority, BM25, excerpts."""

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LIFECYCLE_KINDS
from .text import tokens

# Weights of the ranking terms, the relevance floor and the budgets.
ADDRESS_WEIGHT = 6.0
NAME_WEIGHT = 3.5
TYPE_WEIGHT = 3.0
ADDRESS_PARTIAL_WEIGHT = 4.5
BODY_WEIGHT = 1.0
MIN_RELEVANCE_SCORE = 0.25
DEFAULT_CHAR_BUDGET = 12000
DEFAULT_LIST_BUDGET = 4000
MIN_PER_NODE_BUDGET = 600
MAX_NODES_CEILING = 25
MIN_CHAR_BUDGET = 500
MAX_CHAR_BUDGET = 120000

# BM25 constants, its squashing point and the frequency cut.
K1 = 1.2
B = 0.75
SATURATION = 6.0
UNINFORMATIVE_SHARE = 0.5
MIN_CORPUS_FOR_CUTS = 8

# Path segments of illustrative configuration, and the three demotions.
DEMOTED_SEGMENTS = ("examples", "example", "test", "tests", "fixtures", "testdata", "templates")
DEPRECATED_FACTOR = 0.4
DEMOTED_FACTOR = 0.5
LIFECYCLE_FACTOR = 0.6


def clamp(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


def is_demoted(path: Column) -> Column:
    """True when any segment of a path marks illustrative configuration."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, DEMOTED_SEGMENTS)))


def authority(kind: Column, file: Column, deprecated: Column) -> Column:
    """How far a node counts as operative configuration."""
    return (
        F.when(deprecated, DEPRECATED_FACTOR).otherwise(1.0)
        * F.when(is_demoted(file), DEMOTED_FACTOR).otherwise(1.0)
        * F.when(kind.isin(*LIFECYCLE_KINDS), LIFECYCLE_FACTOR).otherwise(1.0)
    )


def score_exact(query: str) -> Column:
    """Credit for a query that spells an address, a name or a type outright."""
    wanted = F.lower(F.lit(query))

    def credit(column, weight):
        named = (F.col(column) != "") & (F.lower(column) == wanted)
        return F.when(named, weight).otherwise(0.0)

    return credit("address", ADDRESS_WEIGHT) + credit("name", NAME_WEIGHT) + credit("type", TYPE_WEIGHT)


def identity_text() -> Column:
    """What a node declares itself to be."""
    return F.when(
        F.col("kind") == "module_source", F.concat_ws(" ", "address", "source")
    ).otherwise(F.concat_ws(" ", "address", F.when(F.col("type") != "", F.col("type"))))


def coverage(terms: Column, query_fused) -> Column:
    """Share of identity terms that the query has, alone or fused to a neighbour."""
    if not query_fused:
        return F.lit(0.0)

    n = F.size(terms)

    def present(term, i):
        # Negative or overlong positions give NULL through get(), which never matches.
        after, before = F.get(terms, i + 1), F.get(terms, i - 1)
        hit = (
            term.isin(*query_fused)
            | F.coalesce(F.concat(term, after).isin(*query_fused), F.lit(False))
            | F.coalesce(F.concat(before, term).isin(*query_fused), F.lit(False))
        )
        return F.when(hit, 1.0).otherwise(0.0)

    covered = F.aggregate(F.transform(terms, present), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, covered / n).otherwise(F.lit(0.0))


def identity_coverage(query_fused) -> Column:
    return coverage(tokens(identity_text()), query_fused)


def node_text(doc: Column, body: Column) -> Column:
    """A node's prose: leading comments, then its own source."""
    return F.when(doc == "", body).otherwise(F.concat_ws("\n", doc, body))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def is_informative(n_docs: Column, df: Column) -> Column:
    return (n_docs < MIN_CORPUS_FOR_CUTS) | (df <= n_docs * UNINFORMATIVE_SHARE)


def _term_weights(dfs, n_docs: float) -> list[float | None]:
    """A weight for each query term; None for those that too many rows have."""
    return [None if n_docs >= MIN_CORPUS_FOR_CUTS and df > n_docs * UNINFORMATIVE_SHARE
            else math.log(1 + (n_docs - df + 0.5) / (df + 0.5)) for df in dfs]


def _squashed(gains, present, weights, n_plain: int) -> Column:
    """BM25 of the gains, squashed, times the share of the plain terms' weight that is present."""
    total, answered, asked = [F.lit(0.0)], [F.lit(0.0)], 0.0
    for i, (gain, there, weight) in enumerate(zip(gains, present, weights)):
        if weight is None:
            continue
        total.append(F.when(there, weight * gain).otherwise(0.0))
        if i < n_plain:
            asked += weight
            answered.append(F.when(there, weight).otherwise(0.0))
    if asked <= 0:
        return F.lit(0.0)
    bm25 = reduce(add, total)
    return reduce(add, answered) / asked * bm25 / (bm25 + SATURATION)


def gain(f: Column, length: Column, average: float) -> Column:
    """What f occurrences in a text of this length earn, before the term's weight."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(average)))


def score_body(freqs, dfs, n_plain: int, length: Column, n_docs: float, average: float) -> Column:
    """BM25 over the informative query terms, scaled by the share of information answered.

    freqs (columns) and dfs (numbers) are parallel, the n_plain plain query terms first. The
    statistics are plain numbers, so every row evaluates one short expression. Unknown terms
    count as asked for, which is what turns an off-topic question into a miss.
    """
    gains = [gain(f, length, average) for f in freqs]
    return _squashed(gains, [f > 0 for f in freqs], _term_weights(dfs, n_docs), n_plain)


def body_bound(peaks, dfs, n_plain: int, n_docs: float) -> Column:
    """At least score_body of any row whose gains are at most `peaks`; a null peak is a term nobody has."""
    return _squashed(peaks, [p.isNotNull() for p in peaks], _term_weights(dfs, n_docs), n_plain)


def excerpt(body: Column, budget: Column) -> Column:
    """struct<text, truncated, full_len, shown_len>: the first `budget` bytes of a body.

    Lengths count UTF-8 bytes. A character cut in half becomes U+FFFD.
    """
    size = F.octet_length(body)
    head = F.substring(F.encode(body, "UTF-8"), F.lit(1), budget)
    cut = F.make_valid_utf8(head.cast("string"))
    return F.struct(
        F.when(size <= budget, body).otherwise(cut).alias("text"),
        (size > budget).alias("truncated"),
        size.alias("full_len"),
        F.least(size, budget).alias("shown_len"),
    )

