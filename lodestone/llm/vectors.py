"""Vectors in packed blocks: a block of queries stays in its task while blocks of candidates stream past.

Equal vectors are one class, which carries its smallest row ids, one more than are asked for; a
query class is answered once and its own row is taken out afterwards. So copies cost no pairs, and
rows that share a vec_id stay separate rows.

A block is one row with at most BLOCK classes of one dimension, as bytes, so that Spark moves and
places blocks and numpy works on whole matrices. A task merges what it finds into one list for
each query before anything leaves it.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, scope

#: Most classes of a block of candidates and of a block of queries.
BLOCK = 2048
#: Blocks of candidates that one task takes past one block of queries.
PART = 8
#: Rows of one class of queries are spread over so many keys when they fetch their answer.
SALTS = 4

_PACKED = "block string, grp long, n int, hi double, has array<int>, lsts binary, cnts binary, ids binary, vecs binary"


def clean(rows: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v double array, h) of usable rows; a vec_id that comes more than once stays so many rows.

    Left out are null ids, null or empty vectors, those with null or non-finite components and,
    unless `zero`, those of length zero. Other columns are ignored, whatever their names.
    """
    v = F.col("embedding").cast("array<double>")
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        fit = fit & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fit)
    # Adding zero makes the negative zero the positive one, as in comparisons.
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("v"))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """(h, v, ids): a row for each distinct vector with its `most` smallest vec_ids, repeats counted.

    The rank filter cuts a class to `most` rows before the shuffle.
    """
    w = Window.partitionBy("h", "v").orderBy("vec_id")
    first = rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most)
    return first.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of rows (grp, lst, ids, v) that follow each other in a partition with the same grp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        grp, lsts, ids, vecs = None, [], [], []

        def block():
            nonlocal made, lsts, ids, vecs
            m = np.ascontiguousarray(np.stack(vecs), dtype=np.float64)
            made += 1
            out = pd.DataFrame([(f"{part}-{made}", grp, len(vecs), float(lengths(m).max()), sorted(set(lsts)),
                                 np.array(lsts, np.int32).tobytes(), np.array([len(i) for i in ids], np.int32).tobytes(),
                                 np.concatenate(ids).astype(np.int64).tobytes(), m.tobytes())],
                               columns=["block", "grp", "n", "hi", "has", "lsts", "cnts", "ids", "vecs"])
            lsts, ids, vecs = [], [], []
            return out

        for pdf in batches:
            for g, lst, i, v in zip(pdf["grp"].to_numpy(), pdf["lst"].to_numpy(), pdf["ids"], pdf["v"], strict=True):
                if vecs and (g != grp or len(vecs) >= BLOCK):
                    yield block()
                grp = int(g)
                lsts.append(int(lst))
                ids.append(np.asarray(i))
                vecs.append(v)
        if vecs:
            yield block()

    return rows.select("grp", "lst", "ids", "v").mapInPandas(run, _PACKED)


def lengths(m: np.ndarray) -> np.ndarray:
    """Row lengths, infinite only where the length itself leaves the double range."""
    big = np.abs(m).max(1)
    with np.errstate(over="ignore"):
        unit = m / np.where(big > 0, big, 1)[:, None]
        return big * np.sqrt((unit * unit).sum(1))


#: (vectors of a block of queries, their dimension) -> (vectors, lists, thresholds) -> row, column, score.
Scorer = Callable[[np.ndarray, int], Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]]


def best(a: np.ndarray, tie: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each a: largest s first, then smallest tie."""
    order = np.lexsort((tie, -s, a))
    a = a[order]
    return order[np.arange(len(a)) - np.searchsorted(a, a) < k]


def stream(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, scorer: Scorer, k: int, kind: str) -> DataFrame:
    """(qblock, pos, q, rank, vec_id, score, same): the k best rows of each query in each part of its pairs.

    pairs: (qblock, part, turn, block), turns from 1. A task holds one block of queries, its lists and one
    block of candidates; `same` says that the row's vector equals the query. kind: long or double scores.
    """
    floor = -np.inf if kind == "double" else -2 ** 63 + 1
    dtype = np.float64 if kind == "double" else np.int64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None

        def out():
            a, i, s, same = held
            rank = np.arange(len(a)) - np.searchsorted(a, a) + 1
            return pd.DataFrame({"qblock": at[0], "pos": a.astype(np.int32), "q": keys[a], "rank": rank.astype(np.int32),
                                 "vec_id": i, "score": s, "same": same})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.turn == 0:
                    if held is not None and len(held[0]):
                        yield out()
                    at, keys = (r.qblock, r.part), np.frombuffer(r.ids, np.int64)
                    q = np.frombuffer(r.vecs, np.float64).reshape(r.n, -1)
                    theta = np.full(r.n, floor, dtype)
                    for x in () if r.held is None else r.held:
                        theta[x["pos"]] = x["score"]
                    found = scorer(q, q.shape[1])
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype), np.zeros(0, bool))
                    continue
                assert at == (r.qblock, r.part)
                c = np.frombuffer(r.vecs, np.float64).reshape(r.n, -1)
                cnts, ids = np.frombuffer(r.cnts, np.int32), np.frombuffer(r.ids, np.int64)
                start = np.concatenate([[0], np.cumsum(cnts)])
                a, b, s = found(c, np.frombuffer(r.lsts, np.int32), theta)
                # The k best rows lie in the k best classes, by score and smallest id.
                top = best(a, ids[start[b]], s, k)
                a, b, s = a[top], b[top], s[top]
                same = (q[a] == c[b]).all(1)
                n = cnts[b]
                of = np.repeat(np.arange(len(b)), n)
                i = ids[start[b][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
                all_ = [np.concatenate(x) for x in zip(held, (a[of], i, s[of], same[of]), strict=True)]
                top = best(all_[0], all_[1], all_[2], k)
                held = tuple(x[top] for x in all_)
                rank = np.arange(len(top)) - np.searchsorted(held[0], held[0])
                full = rank == k - 1
                theta[held[0][full]] = np.maximum(theta[held[0][full]], held[2][full])
        if held is not None and len(held[0]):
            yield out()

    cols = ["n", "lsts", "cnts", "ids", "vecs"]
    asked = pairs.select("qblock", "part").distinct().join(
        queries.select(F.col("block").alias("qblock"), *cols, "held"), "qblock").withColumn("turn", F.lit(0))
    past = pairs.join(blocks.select("block", *cols), "block").drop("block")
    met = asked.unionByName(past, allowMissingColumns=True)
    met = met.repartition(partitions(pairs.sparkSession), "qblock", "part").sortWithinPartitions("qblock", "part", "turn")
    return met.mapInPandas(run, f"qblock string, pos int, q long, rank int, vec_id long, score {kind}, same boolean")


def retrieve(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, scorer: Scorer, k: int, kind: str) -> DataFrame:
    """(q, best): each query's k best rows as a sorted array of (rank, vec_id, score, same).

    pairs: (qblock, block, prio). The pair of largest prio gives thresholds; of the others those stay
    whose product of largest lengths can reach one.
    """
    spark = pairs.sparkSession
    turn = F.row_number().over(Window.partitionBy("qblock").orderBy(F.desc("prio"), "block")) - 1
    pairs = keep(pairs.withColumn("turn", turn), "pairs")
    none = queries.withColumn("held", F.lit(None).cast(f"array<struct<pos:int,score:{kind}>>"))
    one = pairs.filter("turn = 0").select("qblock", F.lit(0).alias("part"), F.lit(1).alias("turn"), "block")
    # Rows are blocks of megabytes here, so few of them go to a Python worker at once.
    with scope(spark, batch=4) as few:
        first = few.result(stream(one, none, blocks, scorer, k, kind), "first")
    # At most BLOCK thresholds for one block of queries.
    held = first.filter(F.col("rank") == k).groupBy(F.col("qblock").alias("block")).agg(
        F.collect_list(F.struct("pos", "score")).alias("held"), F.count("*").alias("full"),
        F.min("score").cast("double").alias("least"))
    warm = keep(queries.join(held, "block", "left"), "warm")
    reach = warm.select(F.col("block").alias("qblock"), F.col("hi").alias("qhi"),
                        F.when(F.col("full") == F.col("n"), F.col("least")).alias("least"))
    rest = pairs.filter("turn > 0").join(reach, "qblock").join(blocks.select("block", "hi"), "block")
    most = F.col("qhi") * F.col("hi") * (1 + 1e-9) + 1e-9
    rest = rest.filter(F.col("least").isNull() | (most >= F.col("least")) | F.isnan(most))
    rest = rest.select("qblock", F.floor((F.col("turn") - 1) / PART).cast("int").alias("part"), "turn", "block")
    with scope(spark, batch=4) as few:
        more = few.result(stream(rest, warm, blocks, scorer, k, kind), "more")
    cols = ["q", "score", "vec_id", "same"]
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = first.select(cols).unionByName(more.select(cols)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return rows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "same"))).alias("best"))


def asked(queries: DataFrame) -> DataFrame:
    """(q, h, v): the distinct vectors of the queries, numbered."""
    return keep(queries.groupBy("h", "v").agg(F.count("*")).select(F.monotonically_increasing_id().alias("q"), "h", "v"), "asked")


def answers(queries: DataFrame, numbered: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row: its class's list without the row itself."""
    lists = numbered.join(found, "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("q")
    salt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    rows = queries.withColumn("salt", salt).withColumnRenamed("vec_id", "query_id")
    rows = rows.join(lists, ["h", "salt", "v"])
    own = F.array_position(F.transform("best", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), F.lit(True))
    rows = rows.select("query_id", own.cast("int").alias("own"), F.explode("best").alias("x"))
    rows = rows.filter(F.col("x.rank") != F.col("own"))
    rank = F.col("x.rank") - F.when((F.col("own") > 0) & (F.col("x.rank") > F.col("own")), 1).otherwise(0)
    return rows.select("query_id", rank.cast("int").alias("rank"), "x.vec_id", "x.score").filter(F.col("rank") <= k)
