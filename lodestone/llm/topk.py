"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are range-partitioned by length, longest first, into blocks: the buckets. A query's
first threshold comes from the longest bucket. A pair of query block and bucket whose product of
largest lengths is below every threshold of the block is never formed. Within a bucket each query
has the local cosine threshold theta / (|q| * longest of the bucket); a low one keeps almost all
directions, so candidates are cut by length alone (a prefix of the bucket, which is sorted by
length), a high one is worth checking the query's largest coordinates: a unit vector with cosine t
to the query has coordinate f within q_f t +- sqrt((1 - t^2)(1 - q_f^2)). What remains is screened
by floating-point products with their error bound, and then multiplied exactly: in floating point
or 64-bit integers where a bound on the sum allows it, otherwise in integers of any size.

Defined results: components are whole numbers after scaling, exactly; one whose scaled value leaves
the double range counts as the largest double. Scores beyond +-(2^63 - 1) count as that, and tie.
See `vectors.clean` for what takes part; vectors only meet those of their own dimension; ties go to
the smaller vec_id; a query without candidates, or an empty table, has no rows.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import keep, partitions, scope

#: From this local cosine threshold on, coordinates are checked, so many of them.
COSINE = 0.6
FOCUS = 4
#: Bound of a score's absolute value.
MOST = 2 ** 63 - 1
#: Error of a product of vectors scaled to components of at most one, for each component.
EPS = 2.0 ** -50
#: Room for rounding, as a part of a length.
SLACK = 1e-9


def scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with components of at most one, exponents e): m = rows * 2^e, exactly but for tiny components."""
    e = np.frexp(np.abs(m).max(1))[1]
    # Twice, since 2^-e itself can leave the double range.
    return np.ldexp(np.ldexp(m, -(e // 2)[:, None]), -(e - e // 2)[:, None]), e


def exact(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of whole-number row pairs as 64-bit integers, beyond +-MOST cut to that."""
    from .nearest import products

    if len(a) == 0:
        return np.zeros(0, np.int64)
    big_q, big_c = np.abs(q).max(1)[a], np.abs(c).max(1)[b]
    with np.errstate(over="ignore"):
        bound = big_q * big_c * q.shape[1] * (1 + 1e-9)
    out = np.zeros(len(a), np.int64)
    small = bound < 2.0 ** 53
    out[small] = products(q, c, a[small], b[small]).astype(np.int64)
    middle = np.nonzero(~small & (bound < 2.0 ** 63) & (big_q < 2.0 ** 63) & (big_c < 2.0 ** 63))[0]
    if len(middle):
        out[middle] = products(np.where(np.abs(q) < 2.0 ** 63, q, 0).astype(np.int64),
                               np.where(np.abs(c) < 2.0 ** 63, c, 0).astype(np.int64), a[middle], b[middle])
    rest = np.nonzero(~small & ~np.isin(np.arange(len(a)), middle))[0]
    if len(rest):
        # Only what may lie inside the range needs the whole sum.
        (sq, eq), (sc, ec) = scaled(q), scaled(c)
        s, e = products(sq, sc, a[rest], b[rest]), eq[a[rest]] + ec[b[rest]]
        err = EPS * q.shape[1]
        with np.errstate(over="ignore"):
            high, low = np.ldexp(s - err, e) > 2.0 ** 63, np.ldexp(s + err, e) < -2.0 ** 63
        out[rest[high]], out[rest[low]] = MOST, -MOST
        for j in rest[~high & ~low]:
            total = sum(int(x) * int(y) for x, y in zip(q[a[j]], c[b[j]], strict=True))
            out[j] = max(-MOST, min(MOST, total))
    return out


def scorer(q: np.ndarray, dim: int, k: int):
    """Products at or above each query's threshold, by length or coordinate pruning."""
    qlen = V.lengths(q)
    sq, eq = scaled(q)

    def screen(rows, sc, ec, cols, theta):
        """Which (row, column) pairs can reach the threshold, by scaled products."""
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.ldexp(sq[rows] @ sc[:cols].T + EPS * dim, eq[rows][:, None] + ec[None, :cols])
        # Everything reaches the lowest score there is, which larger negative ones count as.
        least = np.where(theta[rows] <= -2.0 ** 63, -np.inf, theta[rows] * (1 - np.sign(theta[rows]) * 1e-15))
        return s >= least[:, None]

    def run(c, lst, theta):
        length = V.lengths(c)
        by = np.argsort(-length, kind="stable")
        length, c = length[by], c[by]
        sc, ec = scaled(c)
        limit = theta.astype(np.float64)
        cold = np.nonzero(limit <= -2.0 ** 63)[0]
        if len(cold) and len(c) > k:  # a threshold from this bucket, below the k-th score by the error at most
            with np.errstate(over="ignore"):
                s = np.ldexp(sq[cold] @ sc.T - EPS * dim, eq[cold][:, None] + ec[None, :])
            limit[cold] = np.maximum(limit[cold], np.minimum(2.0 ** 63, np.partition(s, len(c) - k, axis=1)[:, len(c) - k]))
        with np.errstate(divide="ignore", invalid="ignore"):
            need = limit / qlen
            local = need / length[0] if length[0] else np.where(limit > 0, np.inf, -np.inf)
        need, local = np.where(np.isnan(need), -np.inf, need), np.where(np.isnan(local), -np.inf, local)
        # Length pruning: the prefix that is long enough for the query.
        end = np.searchsorted(-length, -need * (1 - SLACK) + SLACK, side="right")
        end = np.where(need <= 0, len(length), end)
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        high = (local >= COSINE) & (end > 0)
        plain = np.nonzero(~high & (end > 0))[0]
        if len(plain):
            most = int(end[plain].max())
            x, y = np.nonzero(screen(plain, sc, ec, most, limit) & (np.arange(most) < end[plain, None]))
            rows.append(plain[x])
            cols.append(y)
        unit = c / np.where(length > 0, length, 1)[:, None] if high.any() else None
        for i in np.nonzero(high)[0]:
            m = end[i]
            t, u = min(1.0, local[i] * (1 - SLACK)), q[i] / qlen[i]
            stay = np.ones(m, bool)
            for f in np.argsort(-np.abs(u))[:FOCUS]:
                reach = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-6
                lo = -1.0 if u[f] <= -t else u[f] * t - reach
                hi = 1.0 if u[f] >= t else u[f] * t + reach
                stay &= (unit[:m, f] >= lo - SLACK) & (unit[:m, f] <= hi + SLACK)
            y = np.nonzero(stay)[0]
            y = y[screen(np.array([i]), sc[y], ec[y], len(y), limit)[0]]
            rows.append(np.full(len(y), i))
            cols.append(y)
        a, b = np.concatenate(rows), np.concatenate(cols)
        s = exact(q, c, a, b)
        ok = s >= theta[a]
        return a[ok], by[b[ok]], s[ok]

    return run


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows and queries of whole numbers as `vectors.clean` returns them."""
    n, k1 = partitions(rows.sparkSession), k + 1  # one more: the query itself
    group = lambda df: df.withColumn("grp", F.size("v").cast("long")).withColumn("lst", F.lit(0))
    big = F.array_max(F.transform("v", F.abs))
    unit = F.aggregate("v", F.lit(0.0), lambda t, x: t + (x / big) * (x / big))
    length = F.when(big > 0, big * F.sqrt(unit)).otherwise(0.0)
    ranged = group(V.classes(rows, k1)).withColumn("len", length).repartitionByRange(n, "grp", F.desc("len"), "h")
    blocks = keep(V.pack(ranged.sortWithinPartitions("grp", F.desc("len"), "h")), "buckets")
    numbered = V.asked(queries)
    asked = group(numbered.withColumn("ids", F.array("q"))).repartitionByRange(n, "grp", "h")
    asked = keep(V.pack(asked.sortWithinPartitions("grp", "h")), "asked-blocks")
    # Spark weighs blocks here, not rows: one pair for a block of queries and a bucket.
    pairs = asked.select(F.col("block").alias("qblock"), "grp").join(
        blocks.select("block", "grp", F.col("hi").alias("prio")), "grp").drop("grp")
    return V.answers(queries, numbered, V.retrieve(pairs, asked, blocks, lambda q, dim: scorer(q, dim, k1), k1, "long"), k)


def whole(x, scale: int):
    """floor(scale * x) as a double; from 2^52 on a double is whole already."""
    x, most = x * F.lit(float(scale)), F.lit(float(np.finfo(np.float64).max))
    return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(F.greatest(-most, F.least(most, x)))


def embeddings_top(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """The k largest integer products of floor(scale * x) for rows whose vec_id is divisible by `every`."""
    with scope(embeddings.sparkSession) as tables:
        rows = V.clean(embeddings, zero=True).withColumn("v", F.transform("v", lambda x: whole(x, scale)))
        rows = keep(rows.withColumn("h", F.xxhash64("v")), "whole")
        return tables.result(search(rows, rows.filter(F.col("vec_id") % every == 0), k), "top")
