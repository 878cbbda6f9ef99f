"""The kept index beside a pass over every node, and what a question reads of it."""

import pytest

from lodestone.functions import scoring as S
from lodestone.operators import explore, postings
from lodestone.operators.corpus import Corpus
from lodestone.sources.tables import as_nodes
from tests.test_ranking import BODIES


@pytest.fixture(scope="module")
def nodes(spark):
    rows = []
    for i in range(90):
        body = BODIES[i % len(BODIES)] + (" cargo" * (i % 4)) + f" only{i}"
        rows.append((i, f"T_{body.split()[0]}.N{i}", body, i % 7 == 0, "examples/x" if i % 5 == 0 else "main"))
    rows += [(90, "", "", False, ""), (91, "crane", "crane crane", False, "m"), (92, "a.b", "crane Cargo", False, "m"), (92, "a.b", "crane Cargo", False, "m")]
    df = spark.createDataFrame(rows, "i int, address string, body string, old boolean, file string")
    return as_nodes(df, "i", kind="CASE WHEN i % 11 = 0 THEN 'moved' WHEN i % 3 = 0 THEN 'module_source' ELSE 'resource' END",
                    module_dir="concat('d', i % 3)", address="address", name="concat('n', i)", type="CASE WHEN i % 2 = 0 THEN 'Crane' ELSE '' END",
                    source="'quay ship'", body="body", file="file", deprecated="old").cache()


@pytest.fixture(scope="module")
def index(nodes):
    old, postings.SPAN = postings.SPAN, 8
    yield postings.PostingIndex.build(nodes)
    postings.SPAN = old


@pytest.mark.parametrize("query", ["zeppelin cargo crane", "Crane", "tcrane n22", "quay ship berth lamp", "the"])
def test_scores_equal_a_full_pass(nodes, index, query):
    full = {(r["node_key"], r["score"]) for r in explore.score_nodes(Corpus.build(nodes), query).collect()}
    got = [(r["node_key"], r["score"]) for r in index.every_score(query).collect()]
    assert len(got) == nodes.count()
    for (a, x), (b, y) in zip(sorted(set(got)), sorted(full), strict=True):
        assert a == b and x == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("query", ["Crane", "berth quay lamp"])
def test_answers_equal_a_full_pass(nodes, index, query):
    a = explore.explore(nodes, query, max_nodes=7)
    b = explore.explore(nodes, query, max_nodes=7, index=index)
    assert a.counters.collect() == b.counters.collect()
    rows = [[(r["node_key"], r["node_seq"], round(r["score"], 9)) for r in x.hits.collect()] for x in (a, b)]
    assert rows[0] == rows[1]


def test_ranges_below_the_floor_are_left_out(nodes, index):
    every = {r["doc"]: r["score"] for r in index.scores("lamp zeppelin dirigible", floor=0.0).collect()}
    kept = {r["doc"]: r["score"] for r in index.scores("lamp zeppelin dirigible").collect()}
    assert set(kept) <= set(every)
    assert {d for d, s in every.items() if s >= S.MIN_RELEVANCE_SCORE} <= set(kept)


def test_a_question_reads_its_own_lists(spark, index):
    """Folder and key filters reach the scan, and few of its files are opened."""
    asked = index.body.filter(postings.F.col("bucket").isin([3]) & postings.F.col("key").isin(["lamp"]))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(key), EqualTo(key,lamp)]" in plan
    plan = asked.select("span", "n")._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in plan.split("ReadSchema")[1]
    folder = index.body.select("bucket").distinct().count()
    asked.count()
    files = [int(x) for x in _metric(asked, "numFiles")]
    assert files and sum(files) <= len(index.body.inputFiles()) // folder + 8


def _metric(df, name):
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains(name):
            yield metrics.apply(name).value()


def test_empty_graph(nodes):
    index = postings.PostingIndex.build(nodes.limit(0))
    result = explore.explore(nodes.limit(0), "cargo", index=index)
    assert result.hits.count() == 0 and result.counters.first()["considered"] == 0


def test_entries_are_not_moved(nodes):
    """Rows move once, as their terms; counting and grouping their entries needs no shuffle of its own."""
    rows = nodes.selectExpr("monotonically_increasing_id() AS doc", "split(body, ' ') AS terms")
    entries = postings._placed(postings._ranged(rows, 94).select("doc", "span", postings.F.explode("terms").alias("key")))
    counted = entries.groupBy("bucket", "key", "span", "doc").agg(postings.F.count("*").cast("double").alias("w"))
    blocks = postings._blocks(counted, ["key"], ["doc", "w"], postings.F.col("w"))
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sum(r["n"] for r in blocks.collect()) == counted.count()


def test_blocks_equal_counting_by_hand(spark, monkeypatch):
    """Terms and pairs counted in chunks of any size, for rows that have many terms, one, none or no list."""
    texts = [["a", "b", "a", "b"], None, ["ab"], [], ["é", "a", "b"], ["a"] * 9] * 3
    rows = spark.createDataFrame([(i, 1.0, len(t or []) * 1.5, t) for i, t in enumerate(texts)],
                                 "doc long, authority double, length double, terms array<string>").coalesce(1)
    expected = {}
    for doc, terms in enumerate(texts):
        for key, w in [(t, 1.0) for t in terms or []] + [(a + b, 0.5) for a, b in zip(terms or [], (terms or [])[1:])]:
            expected[key, doc] = expected.get((key, doc), 0) + w
    for most, entries in ((1, 1), (7, 3), (1 << 20, 1 << 17)):
        monkeypatch.setattr(postings.posted, "TERMS", most)
        monkeypatch.setattr(postings.posted, "ENTRIES", entries)
        blocks = postings.posted.blocks(rows, 4, 3.0, S.K1, S.B, 0.5, postings.BUCKETS)
        blocks = blocks.withColumn("same", postings._bucket(postings.F.col("key")) == postings.F.col("bucket")).collect()
        assert {(r["key"], e["doc"]): e["w"] for r in blocks for e in r["entries"]} == expected
        assert sum(r["n"] for r in blocks) == len(expected) and all(r["same"] and r["n"] == len(r["entries"]) for r in blocks)
        for r in blocks:
            assert {e["doc"] // 4 for e in r["entries"]} == {r["span"]}
            gains = [e["w"] * (S.K1 + 1) / (e["w"] + S.K1 * (1 - S.B + S.B * e["length"] / 3.0)) for e in r["entries"]]
            assert r["peak"] == pytest.approx(max(gains))
    plan = blocks and postings.posted.blocks(rows, 4, 3.0, S.K1, S.B, 0.5, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Generate" not in plan
