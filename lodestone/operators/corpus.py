"""Term statistics of a graph: document frequency, lengths, rarity."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X


def document_frequency(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, df) over the fused terms of each row.

    Terms are made distinct inside their row, so one map-combined shuffle on the term is
    enough and a term that every document has costs one row per map task.
    """
    both = F.array_distinct(F.concat(F.col(terms), X.pairs(F.col(terms))))
    return (
        docs.select(F.explode(both).alias("term"))
        .groupBy("term").agg(F.count("*").cast("double").alias("df"))
    )


def corpus_stats(docs: DataFrame, length: str = "length") -> DataFrame:
    """One row (n_docs, total_length, avg_length); an empty corpus averages 1."""
    total = F.coalesce(F.sum(length), F.lit(0.0))
    n = F.count("*")
    return docs.agg(
        n.cast("double").alias("n_docs"),
        total.alias("total_length"),
        F.greatest(F.lit(1.0), total / F.greatest(n, F.lit(1))).alias("avg_length"),
    )


IDENTITY = (
    "node_key", "module_dir", "address", "kind", "type", "name", "source", "file", "deprecated",
)


@dataclass(frozen=True)
class Corpus:
    """docs: every node with its terms and length instead of its text, and what follows from it.

    The identity columns stay beside the terms, so ranking reads one table and joins nothing.
    All parts are lazy; cut docs to keep them.
    """

    docs: DataFrame

    @classmethod
    def build(cls, nodes: DataFrame) -> "Corpus":
        terms = nodes.select(
            "node_seq", *IDENTITY, X.tokens(S.node_text(F.col("doc"), F.col("body"))).alias("terms")
        )
        return cls(terms.withColumn("length", X.fused_length(F.col("terms"))))

    @property
    def postings(self) -> DataFrame:
        """(node_key, term, weight) over fused terms."""
        return (
            self.docs.select("node_key", F.explode(X.fused(F.col("terms"))).alias("p"))
            .groupBy("node_key", F.col("p.term").alias("term"))
            .agg(F.sum("p.weight").alias("weight"))
        )

    @property
    def term_df(self) -> DataFrame:
        return document_frequency(self.docs)

    @property
    def stats(self) -> DataFrame:
        return corpus_stats(self.docs)

    def inverse_document_frequency(self) -> DataFrame:
        """(term, df, idf, informative) of every term in the corpus."""
        n = self.docs.agg(F.count("*").cast("double").alias("n")).scalar()
        return self.term_df.select(
            "term", "df",
            S.idf(n, F.col("df")).alias("idf"),
            S.is_informative(n, F.col("df")).alias("informative"),
        )

    def weight_by_rarity(self, vector: DataFrame) -> DataFrame:
        """A query vector (term, weight) scaled by idf, uninformative terms dropped.

        Terms the corpus lacks have a document frequency of 0 and stay. A query is a line of
        text, so its terms filter the corpus before anything is counted.
        """
        n = self.docs.agg(F.count("*").cast("double").alias("n")).scalar()
        known = document_frequency(self.docs).join(vector.select("term"), "term", "left_semi")
        df = F.coalesce(F.col("df"), F.lit(0.0))
        return (
            vector.join(known, "term", "left")
            .filter(S.is_informative(n, df))
            .select("term", (F.col("weight") * S.idf(n, df)).alias("weight"))
        )
