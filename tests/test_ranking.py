import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.operators.corpus import Corpus
from lodestone.operators.explore import explore
from lodestone.sources.tables import as_nodes

BODIES = [
    "crane lifts cargo", "cargo cargo ship", "ship berth quay", "quay crane cargo ship berth", "tide table", "pilot boat",
    "customs papers for cargo", "customs seal", "lighthouse lamp", "rope and anchor", "cargo",
]


def make_nodes(spark):
    rows = [(i, f"t_{b.split()[0]}.n{i}", b) for i, b in enumerate(BODIES)]
    df = spark.createDataFrame(rows, "i int, address string, body string")
    return as_nodes(df, "i", kind="'resource'", module_dir="concat('d', i % 3)", address="address",
                    name="concat('n', i)", type="split(address, '[.]')[0]", body="body", file="'main.tf'")


def brute(query):
    """Scores by the published formula, in plain Python."""
    def toks(s):
        import re
        return [t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith("ss") else t
                for t in re.findall(r"[a-z0-9]+", s.lower()) if len(t) > 1 and t not in ("and", "for", "the")]

    def vec(ts):
        v = Counter(ts)
        for a, b in zip(ts, ts[1:]):
            v[a + b] += 0.5
        return v

    q = vec(toks(query))
    docs = [vec(toks(b)) for b in BODIES]
    n, avg = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(t for d in docs for t in d)
    useful = [t for t in q if df[t] <= n / 2]

    def idf(t):
        return math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))

    plain = [t for t in dict.fromkeys(toks(query)) if t in useful]
    out = {}
    for i, d in enumerate(docs):
        length = sum(d.values())
        bm = sum(idf(t) * d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * length / avg)) for t in useful if d[t])
        asked, answered = sum(map(idf, plain)), sum(idf(t) for t in plain if d[t])
        body = answered / asked * bm / (bm + 6) if asked and answered else 0.0
        address = f"t_{BODIES[i].split()[0]}.n{i}"
        ident = toks(address + " " + address.split(".")[0])
        hit = sum(1 for j, t in enumerate(ident) if t in q or (j + 1 < len(ident) and t + ident[j + 1] in q)
                  or (j and ident[j - 1] + t in q))
        out[f"d{i % 3}|{address}"] = 4.5 * hit / len(ident) + body
    return out


@pytest.mark.parametrize("query", ["cargo crane", "customs papers", "zeppelin cargo", "ship berth quay"])
def test_scores_match_brute_force(spark, query):
    nodes = make_nodes(spark)
    result = explore(nodes, query, max_nodes=25, char_budget=120000)
    expected = {k: v for k, v in brute(query).items() if v >= S.MIN_RELEVANCE_SCORE}
    got = {r["node_key"]: r["score"] for r in result.hits.collect()}
    assert got == pytest.approx(expected)
    counters = result.counters.first()
    assert counters["considered"] == len(BODIES)
    assert counters["above_threshold"] == len(expected)


def test_blank_query_has_no_hits(spark):
    result = explore(make_nodes(spark), "   ")
    assert result.hits.count() == 0
    assert result.counters.first().asDict() == {
        "considered": 11, "above_threshold": 0, "shown": 0, "dropped_for_budget": 0}


def test_budget_bounds_the_number_of_hits(spark):
    nodes = make_nodes(spark)
    result = explore(nodes, "crane cargo ship quay", max_nodes=4, char_budget=1200)
    assert result.hits.count() == 2
    assert result.counters.first()["dropped_for_budget"] == 2
    assert explore(nodes, "crane cargo ship quay", max_nodes=4, char_budget=1).hits.count() == 4  # 500 buys no whole share


def test_authority_demotions_multiply(spark):
    rows = spark.createDataFrame([
        ("resource", "stacks/a/main.tf", False, 1.0), ("resource", "stacks/a/main.tf", True, 0.4),
        ("resource", "Examples/a/main.tf", False, 0.5), ("moved", "a/tests/main.tf", True, 0.12),
        ("import", "contest/main.tf", False, 0.6),
    ], "kind string, file string, deprecated boolean, expected double")
    for r in rows.withColumn("got", S.authority(F.col("kind"), F.col("file"), F.col("deprecated"))).collect():
        assert r["got"] == pytest.approx(r["expected"]), r


def test_excerpt_counts_bytes(spark):
    row = spark.createDataFrame([("aé" * 5,)], "b string").select(S.excerpt(F.col("b"), F.lit(5)).alias("e")).first()["e"]
    assert row["truncated"] and row["full_len"] == 15 and row["shown_len"] == 5
    assert row["text"] == "aéa�"


def test_uninformative_terms_carry_no_weight(spark):
    """A query of words that most nodes share is a miss; in a tiny corpus nothing is cut."""
    df = spark.range(10).withColumn("body", F.lit("alpha beta"))
    many = as_nodes(df, "id", kind="'data'", module_dir="''", address="concat('zz.q', id)", body="body")
    assert explore(many, "alpha").hits.count() == 0
    corpus = Corpus.build(many)
    assert [r["informative"] for r in corpus.inverse_document_frequency().collect()] == [False] * 3
    vector = spark.createDataFrame([("alpha", 1.0), ("gamma", 2.0)], "term string, weight double")
    weighted = {r["term"]: r["weight"] for r in corpus.weight_by_rarity(vector).collect()}
    assert weighted == {"gamma": pytest.approx(2 * math.log(1 + 10.5 / 0.5))}


def test_unfused_address_reaches_compound_name(sky):
    hits = sky.explore("geartrain axle").hits.collect()
    assert hits[0]["node_key"] == "lib/motor|gear_train.axle"
