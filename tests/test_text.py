import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X

STEMS = [
    ("ports", "port"), ("crates", "crate"), ("berths", "berth"), ("ferries", "ferry"), ("buses", "bus"),
    ("boxes", "box"), ("bushes", "bush"), ("gas", "gas"), ("ips", "ips"), ("glass", "glass"), ("dock", "dock"),
    ("k8", "k8"), ("ties", "tie"), ("databases", "databas"),
]


def tokens_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(X.tokens(F.col("t"))).first()[0]


def test_stem_table(spark):
    rows = spark.createDataFrame(STEMS, "word string, stem string")
    got = {r["word"]: r["got"] for r in rows.withColumn("got", X.stem(F.col("word"))).collect()}
    assert got == dict(STEMS)


def test_compound_names_split(spark):
    assert tokens_of(spark, "mq_topic.Main-42 arrivals") == ["mq", "topic", "main", "42", "arrival"]


def test_stop_words_and_short_tokens_drop(spark):
    assert tokens_of(spark, "where does the X log live") == ["log", "live"]
    assert tokens_of(spark, "é a ü1") == ["é", "ü1"]  # lengths are bytes


def test_pair_is_a_bridge_not_evidence(spark):
    row = spark.createDataFrame([(1, "mq topic")], "id int, t string")
    weights = {r["term"]: r["weight"] for r in X.vectorize_fused(row, "id", "t").collect()}
    assert weights == {"mq": 1.0, "topic": 1.0, "mqtopic": 0.5}


def _vector(tokens):
    v = Counter(tokens)
    for a, b in zip(tokens, tokens[1:]):
        v[a + b] += 0.5
    return v


words = st.lists(st.sampled_from(["port", "crane", "ship", "dock", "portcrane", "the"]), max_size=8).map(" ".join)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(words, words), min_size=3, max_size=8))
def test_similarity_matches_brute_force(spark, texts):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id int, a string, b string")
    got = {r["id"]: r["similarity"] for r in X.similarity(df, "id", "a", "b").collect()}
    back = {r["id"]: r["similarity"] for r in X.similarity(df, "id", "b", "a").collect()}
    for i, (a, b) in enumerate(texts):
        va, vb = (_vector([t for t in s.split() if t != "the"]) for s in (a, b))
        dot = sum(w * vb[t] for t, w in va.items())
        norm = math.sqrt(sum(w * w for w in va.values())) * math.sqrt(sum(w * w for w in vb.values()))
        assert got[i] == pytest.approx(dot / norm if dot else 0.0)
        assert back[i] == pytest.approx(got[i])


def test_length_is_the_sum_of_fused_weights(spark):
    df = spark.createDataFrame([(0, ""), (1, "port"), (2, "port crane port ship")], "id int, t string")
    terms = df.select("id", X.tokens(F.col("t")).alias("terms"))
    lengths = {r["id"]: r["n"] for r in terms.select("id", X.fused_length(F.col("terms")).alias("n")).collect()}
    sums = {r["id"]: r["n"] for r in X.vectorize_fused(df, "id", "t").groupBy("id").agg(F.sum("weight").alias("n")).collect()}
    assert lengths == {0: 0.0, 1: 1.0, 2: 5.5}
    assert sums == {1: 1.0, 2: 5.5}


def test_query_terms_keep_order_without_repeats(spark):
    assert X.query_terms(spark, "the crane ports crane") == (["crane", "port"], ["crane", "port", "craneport", "portcrane"])
