"""Terms of a text as Spark columns: tokens, stems, fused pairs, postings, similarity.

Everything here stays in the JVM. A text's tokens are one array per row, so fusing
neighbours and measuring lengths need no shuffle; only long-form postings group.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words dropped before stemming.
STOP_WORDS = (
    "the", "and", "for", "with", "this", "that",
    "from", "are", "was", "were", "has", "have",
    "had", "not", "but", "you", "your", "its",
    "all", "can", "will", "into", "when", "how",
    "why", "who", "where", "which", "what", "does",
    "did", "get", "getting", "got", "make", "made",
    "need", "want", "show", "tell", "give", "let",
    "use", "using", "used", "any", "some", "there",
    "here", "then", "than", "them", "they", "our",
    "set", "sets", "add", "adds",
)

# Token pattern, shortest token in bytes, weight of an adjacent pair.
WORD = r"[\p{L}\p{Nd}]+"
MIN_TOKEN_BYTES = 2
FUSED_WEIGHT = 0.5


def words(text: Column) -> Column:
    """Lowercase runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def stem(token: Column) -> Column:
    """Fold a plural onto its singular; the length floors count bytes."""
    size, chars = F.octet_length(token), F.length(token)
    two_letter_plural = (
        token.endswith("ses") | token.endswith("xes") | token.endswith("zes") | token.endswith("hes")
    )
    return (
        F.when((size > 4) & token.endswith("ies"), F.concat(F.left(token, chars - 3), F.lit("y")))
        .when((size > 4) & two_letter_plural, F.left(token, chars - 2))
        .when((size > 3) & token.endswith("s") & ~token.endswith("ss"), F.left(token, chars - 1))
        .otherwise(token)
    )


def tokens(text: Column) -> Column:
    """Stemmed terms of a text in order, without stop words or one-byte tokens."""
    kept = F.filter(
        words(text),
        lambda w: (F.octet_length(w) >= MIN_TOKEN_BYTES) & ~w.isin(*STOP_WORDS),
    )
    return F.transform(kept, stem)


def pairs(terms: Column) -> Column:
    """Each term joined to its right neighbour."""
    n = F.greatest(F.size(terms) - 1, F.lit(0))
    return F.zip_with(F.slice(terms, F.lit(1), n), F.slice(terms, F.lit(2), n), lambda a, b: F.concat(a, b))


def fused_length(terms: Column) -> Column:
    """Sum of all fused weights: n terms and n - 1 half-weight pairs."""
    n = F.size(terms)
    return F.when(n > 0, n + FUSED_WEIGHT * (n - 1)).otherwise(F.lit(0.0))


def fused(terms: Column) -> Column:
    """array<struct<term, weight>> with repeats: every term at 1, every pair at one half."""
    def weigh(weight):
        return lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight"))

    return F.concat(F.transform(terms, weigh(1.0)), F.transform(pairs(terms), weigh(FUSED_WEIGHT)))


def vectorize(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): plain term counts."""
    return (
        df.select(key, F.explode(tokens(F.col(text))).alias("term"))
        .groupBy(key, "term").agg(F.count("*").cast("double").alias("weight"))
    )


def vectorize_fused(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): plain terms plus adjacent pairs.

    All rows of one key come from one input row, so the map-side combine does the counting
    and the shuffle moves each (key, term) once.
    """
    return (
        df.select(key, tokens(F.col(text)).alias("terms"))
        .select(key, F.explode(fused(F.col("terms"))).alias("p"))
        .groupBy(key, F.col("p.term").alias("term")).agg(F.sum("p.weight").alias("weight"))
    )


def similarity(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, similarity): cosine of two text columns of the same row, fused on both sides.

    Both texts feed one posting stream tagged by side, so each pair costs one grouped
    aggregate and no join. A side without terms gives 0.
    """
    def side(column, name):
        return F.transform(
            fused(F.col(column)),
            lambda p: F.struct(
                p["term"].alias("term"),
                (p["weight"] if name == "a" else F.lit(0.0)).alias("a"),
                (p["weight"] if name == "b" else F.lit(0.0)).alias("b"),
            ),
        )

    terms = df.select(key, tokens(F.col(left)).alias("l"), tokens(F.col(right)).alias("r"))
    posted = (
        terms.select(key, F.explode_outer(F.concat(side("l", "a"), side("r", "b"))).alias("p"))
        .groupBy(key, F.col("p.term").alias("term"))
        .agg(F.sum("p.a").alias("a"), F.sum("p.b").alias("b"))
    )
    dot = F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0))
    norms = F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))
    return posted.groupBy(key).agg(
        F.when(dot > 0, dot / norms).otherwise(F.lit(0.0)).alias("similarity")
    )


def query_terms(spark, query: str):
    """(plain, fused) distinct terms of a query, by the same expressions as the corpus.

    The input is one literal row, so this needs no job over data.
    """
    row = (
        spark.sql("SELECT :q AS q", args={"q": query})
        .select(tokens(F.col("q")).alias("terms"))
        .select("terms", pairs(F.col("terms")).alias("pairs"))
        .first()
    )
    plain = list(dict.fromkeys(row["terms"]))
    return plain, list(dict.fromkeys(plain + row["pairs"]))
