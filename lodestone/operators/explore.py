"""Ranked retrieval: identity first, body second, with a floor, a cut and a budget."""

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..runtime import cut
from .corpus import Corpus
from .postings import PostingIndex


@dataclass(frozen=True)
class ExploreResult:
    """hits: at most 25 ranked rows. counters: one row saying what was left out.

    instances: those of the hits by node_key, or None where no overlay can be used.
    """

    hits: DataFrame
    counters: DataFrame
    instances: DataFrame | None = None


def _frequency(term: str):
    """Fused weight of one query term in a row's matched terms and pairs."""
    return (
        F.size(F.filter("own", lambda t: t == term))
        + X.FUSED_WEIGHT * F.size(F.filter("adjacent", lambda t: t == term))
    )


def matches(corpus: Corpus, query: str) -> tuple[DataFrame, int, list[str]]:
    """(rows, plain, freqs): what one query needs of each node, and nothing of its text.

    A row keeps its identity score, authority, length and one frequency per query term, named
    in freqs; the first `plain` of them are plain terms, the rest pairs. Nothing is exploded,
    joined or grouped, so this is one narrow pass.
    """
    query = query.strip()
    plain, both = X.query_terms(corpus.docs.sparkSession, query)
    carried = ("node_key", "node_seq", "module_dir", "address", "identity", "authority", "length")

    def occurring(terms):
        return F.filter(terms, lambda t: t.isin(*both) if both else F.lit(False))

    freqs = [f"f{i}" for i in range(len(both))]
    rows = corpus.docs.select(
        "node_key", "node_seq", "module_dir", "address", "terms", "length",
        (S.score_exact(query) + S.ADDRESS_PARTIAL_WEIGHT * S.identity_coverage(both)).alias("identity"),
        S.authority(F.col("kind"), F.col("file"), F.col("deprecated")).alias("authority"),
    ).select(
        *carried, occurring(F.col("terms")).alias("own"), occurring(X.pairs(F.col("terms"))).alias("adjacent")
    ).select(*carried, *[_frequency(term).alias(name) for name, term in zip(freqs, both)])
    return rows, len(plain), freqs


def score_matches(rows: DataFrame, plain: int, freqs: list[str]) -> DataFrame:
    """(node_key, module_dir, address, score) of every node, before the floor.

    rows are read twice, for the statistics and for the scores, so keep them first.
    """
    n = F.count("*")
    stats = rows.agg(
        n.cast("double").alias("n"),
        F.greatest(
            F.lit(1.0), F.coalesce(F.sum("length"), F.lit(0.0)) / F.greatest(n, F.lit(1))
        ).alias("average"),
        *[F.count_if(F.col(name) > 0).cast("double").alias(name) for name in freqs],
    ).first()  # one row: two numbers and one per query term
    body = S.score_body(
        [F.col(name) for name in freqs], [stats[name] for name in freqs],
        plain, F.col("length"), stats["n"], stats["average"],
    )
    return rows.select(
        "node_key", "node_seq", "module_dir", "address",
        ((F.col("identity") + S.BODY_WEIGHT * body) * F.col("authority")).alias("score"),
    )


def score_nodes(corpus: Corpus, query: str) -> DataFrame:
    """The score of every node, unranked and uncut."""
    rows, plain, freqs = matches(corpus, query)
    return score_matches(cut(rows), plain, freqs)


def edge_counts(outgoing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """(node_key, ref_count, ref_by_count) over all edge kinds, for at most 25 hits.

    The keys are literals, so the filters reach the scans of the edges, each sorted by its own end.
    """
    ends = outgoing.filter(F.col("from_key").isin(keys)).select(F.col("from_key").alias("node_key"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(
        incoming.filter(F.col("to_key").isin(keys)).select(F.col("to_key").alias("node_key"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node_key").agg(F.sum("out").alias("ref_count"), F.sum("in").alias("ref_by_count"))


def _ranked(index: PostingIndex, query: str, shown: int) -> tuple[int, int, list]:
    """(rows considered, rows above the floor, the best rows) of an indexed question."""
    above = index.scores(query).filter(F.col("score") >= S.MIN_RELEVANCE_SCORE).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_above = above.count()
        # Numbers follow the order in which ties are listed.
        best = above.orderBy(F.round("score", 9).desc(), "doc").limit(shown).collect()
    finally:
        above.unpersist()
    scores = {row["doc"]: row["score"] for row in best}
    named = index.lookup(list(scores)).select("doc", "node_key", "node_seq").collect()
    return index.n, n_above, [Row(node_key=r["node_key"], node_seq=r["node_seq"], score=scores[r["doc"]]) for r in named]


def explore(
    nodes: DataFrame,
    query: str,
    edges: DataFrame | None = None,
    corpus: Corpus | None = None,
    max_nodes: int = 5,
    char_budget: int = S.DEFAULT_CHAR_BUDGET,
    index: PostingIndex | None = None,
    incoming: DataFrame | None = None,
) -> ExploreResult:
    """Rank nodes against free text, an address, a name or a type.

    edges (and incoming, if they lie sorted by their other end too) give reference counts.
    With a kept index of the nodes only the question's lists are read; without one every node is
    scored in one pass. Only two counts and the winners' keys and scores (at most MAX_NODES_CEILING rows) pass
    through the driver; the winners' bodies are fetched by a broadcast of those keys.
    """
    spark = nodes.sparkSession
    max_nodes = S.clamp(max_nodes, 1, S.MAX_NODES_CEILING)
    char_budget = S.clamp(char_budget, S.MIN_CHAR_BUDGET, S.MAX_CHAR_BUDGET)
    affordable = char_budget // S.MIN_PER_NODE_BUDGET
    shown = min(max_nodes, affordable) if affordable >= 1 else max_nodes

    # Rounded before ordering, so that equal texts tie whatever the order of a sum was.
    order = [F.round("score", 9).desc(), "module_dir", "address", "node_key", "node_seq"]
    if query.strip() and index is not None:
        considered, n_above, top = _ranked(index, query, shown)
    elif query.strip():
        rows, plain, freqs = matches(corpus or Corpus.build(nodes), query)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scores = score_matches(rows, plain, freqs)
            above = F.col("score") >= S.MIN_RELEVANCE_SCORE
            considered, n_above = scores.agg(F.count("*"), F.count_if(above)).first()
            top = scores.filter(above).orderBy(*order).limit(shown).select("node_key", "node_seq", "score").collect()
        finally:
            rows.unpersist()
    else:
        considered, n_above, top = nodes.count(), 0, []
    counters = spark.createDataFrame(
        [(considered, n_above, len(top), max(min(n_above, max_nodes) - shown, 0))],
        "considered long, above_threshold long, shown long, dropped_for_budget long",
    )
    share = max(S.MIN_PER_NODE_BUDGET, char_budget // max(len(top), 1))

    winners = spark.createDataFrame(top, "node_key string, node_seq string, score double")
    # Files of one directory can declare an address twice; each declaration is a node of its own.
    hits = nodes.filter(F.col("node_key").isin([row["node_key"] for row in top])).join(F.broadcast(winners), ["node_key", "node_seq"]).withColumn(
        "excerpt", S.excerpt(F.col("body"), F.lit(share))
    )
    if edges is not None:
        counts = edge_counts(edges, edges if incoming is None else incoming, [row["node_key"] for row in top])
        hits = hits.join(F.broadcast(counts), "node_key", "left").fillna(0, ["ref_count", "ref_by_count"])
    return ExploreResult(hits.orderBy(*order), counters)
