"""A training corpus from the documents: reject, deduplicate, redact, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, ngram_join, packing, pii, quality
from lodestone.llm.common import keep, row_key, scope, table
from lodestone.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, each row by its own text and language. A label holds for all rows of its doc_id."""
    key = row_key("lang", "text").alias("key")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").distinct()
    keys = docs.select(F.col("doc_id").cast("long").alias("id"), key)
    labels = labels.join(keys, "id").select(F.col("key").alias("doc_id"), "quality", "toxic")
    with scope(spark) as kept:  # counts and scores go, the rejected keys stay
        found = quality.classify(docs.select(key.alias("doc_id"), "lang", "text"), labels)
        gone = kept.result(found.filter(~F.col("keep")).select(F.col("doc_id").alias("key")).distinct(), "rejected")
    return docs.select(*COLUMNS, key).join(gone, "key", "left_anti").select(*COLUMNS)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.first_of_groups(docs).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked."""
    return pii.redact(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out at rates that bring the language domains to their target weights."""
    labelled = mixing.labelled_documents(docs, table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, labelled, mixing.TARGETS).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", ngram_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL has no iterative fits and no tokenizer. tests/llm/test_llm.py checks the n-gram stage against brute force,
#: the other stages by the rules that they state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
