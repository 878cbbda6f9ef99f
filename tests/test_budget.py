import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.operators import budget


def greedy(costs, limit):
    kept, spent = [], 0
    for i, c in enumerate(costs):
        if spent + c <= limit:
            spent += c
            kept.append(i)
    return kept


quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@quick
@given(st.lists(st.integers(1, 30), min_size=1, max_size=25), st.integers(0, 90))
def test_fill_is_greedy_and_whole(spark, costs, limit):
    df = spark.createDataFrame(list(enumerate(costs)), "i int, cost long").repartition(3)
    kept, dropped = budget.fill(df, ["i"], "cost", limit)
    assert [r["i"] for r in kept] == greedy(costs, limit)
    assert dropped == len(costs) - len(kept)


@quick
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 20)), min_size=1, max_size=20), st.integers(0, 90))
def test_fill_grouped_charges_headings(spark, items, limit):
    items = sorted(items, key=lambda t: t[0])
    df = spark.createDataFrame([(i, g, c, 7) for i, (g, c) in enumerate(items)], "i int, g string, cost int, head int")
    kept, dropped = budget.fill_grouped(df, ["g", "i"], "cost", "g", "head", limit)
    expected, spent, current = [], 0, None
    for i, (g, c) in enumerate(items):
        cost = c + (7 if g != current else 0)
        if spent + cost <= limit:
            spent, current = spent + cost, g
            expected.append(i)
    assert [r["i"] for r in kept] == expected
    assert dropped == len(items) - len(kept)


def test_listed_within_stops_after_the_allowance(spark):
    rows = [("x", i, 10) for i in range(60)] + [("y", i, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, cost int")
    got = budget.listed_within(df, ["g"], ["i"], "cost", 35).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"x": 4, "y": 35}
    got = budget.listed_within(df, ["g"], ["i"], "cost", 4000).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"x": 40, "y": 40}


def test_one_long_row_among_many_costs_few_jobs(spark):
    """100,000 rows, one of them dearer than the budget, in a handful of jobs and as by hand."""
    df = spark.range(100_000).selectExpr(
        "cast(id as int) AS i", "concat('g', lpad(cast(id div 40 as string), 5, '0')) AS g",
        "IF(id = 7, 10000, cast(90 + id % 50 as int)) AS cost", "30 AS head")
    rows = df.orderBy("i").collect()
    tracker = spark.sparkContext.statusTracker()

    def jobs(tag, call):
        spark.sparkContext.setJobGroup(tag, tag)
        try:
            return call(), len(tracker.getJobIdsForGroup(tag))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    (kept, dropped), n = jobs("fill", lambda: budget.fill(df, ["i"], "cost", 4000))
    assert [r["i"] for r in kept] == greedy([r["cost"] for r in rows], 4000) and dropped == len(rows) - len(kept)
    assert n <= 6
    (kept, dropped), n = jobs("grouped", lambda: budget.fill_grouped(df, ["g", "i"], "cost", "g", "head", 4000))
    expected, spent, current = [], 0, None
    for r in rows:
        cost = r["cost"] + (r["head"] if r["g"] != current else 0)
        if spent + cost <= 4000:
            spent, current = spent + cost, r["g"]
            expected.append(r["i"])
    assert [r["i"] for r in kept] == expected and dropped == len(rows) - len(kept)
    assert n <= 30


def test_rows_without_a_cost_are_refused(spark):
    for cost in ("0", "-1", "NULL"):
        df = spark.range(3).selectExpr("id AS i", f"IF(id = 1, {cost}, 5) AS cost", "'g' AS g", "1 AS head")
        with pytest.raises(ValueError, match="positive cost"):
            budget.fill(df, ["i"], "cost", 9)
        with pytest.raises(ValueError, match="positive cost"):
            budget.fill_grouped(df, ["g", "i"], "cost", "g", "head", 9)
    assert budget.fill(spark.range(0).selectExpr("id AS i", "1 AS cost"), ["i"], "cost", 9) == ([], 0)


def test_rows_that_cost_nothing_fit_and_rows_without_a_cost_do_not(spark, tmp_path):
    """The registered query on documents with empty texts and texts of unknown length, beside a plain fold."""
    import __spark_entry__ as entry

    costs = [9000, 0, None, 12000, 11000, 0, None, 300]
    df = spark.createDataFrame(list(enumerate(costs)), "doc_id long, n_chars long")
    df.selectExpr("doc_id", "'' AS text", "'en' AS lang", "'s' AS source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in entry.budget_greedy(spark, str(tmp_path)).collect())
    assert got == [(0, 9000, 4), (1, 0, 4), (4, 11000, 4), (5, 0, 4)]
    kept, dropped = budget.fill_table(df, ["doc_id"], "n_chars", 9300)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 5, 7] and dropped == 4
    with pytest.raises(ValueError, match="positive n_chars"):
        budget.fill_table(df.withColumn("n_chars", -df["n_chars"]), ["doc_id"], "n_chars", 9)
