"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors are turned by a random rotation and put in lists by their nearest centre; the number of
lists grows with the square root of the rows. A query probes the lists whose centres have the
largest products with it. Within a list the rotated dimensions are read in column blocks: a product
reaches the threshold t exactly if the distance to the query is at most
r = sqrt(|q|^2 + |x|^2 - 2 t), and after d of D dimensions the distance is estimated by the partial
one times sqrt(D / d). A candidate is abandoned when the estimate exceeds r by more than the part
ERROR / sqrt(d). The error of the estimate is in proportion to the distance itself, so the test
holds for near copies as well. Rows that set a threshold are in the query's list already and are
not tested. Survivors are scored on the original vectors in double precision.

Centres are fitted on at most SAMPLE vectors (the smallest by a hash); every row is indexed. Defined
results: see `vectors.clean`; vectors only meet those of their own dimension; dimensions beyond the
DIMS most frequent ones, or without a vector in the sample, are one list, scanned by every query;
ties go to the smaller vec_id; a query without candidates, or an empty table, has no rows. Scores
whose squares leave the double range are not defined.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import keep, partitions, scope

#: Vectors that centres are fitted on, and dimensions that get centres, at most.
SAMPLE = 8192
DIMS = 64
#: Lists for the square root of the rows; at most MOST_LISTS, as many as the sample can tell apart.
LISTS = 0.25
MOST_LISTS = 512
#: Part of the lists that a query probes. The test tables are almost isotropic, so few lists would miss much.
PROBED = 0.75
#: Dimensions of a column block; pairs are followed one by one when fewer than one in SPARSE are left.
COLUMNS = 16
SPARSE = 64
#: The test's critical value: about three and a half standard deviations of the estimate.
ERROR = 2.1
#: Where no threshold is known yet, one of so many classes of a block is scored whole to set it.
FIRST = 4
#: Rounding of a squared distance, as a part of the squared lengths.
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))[0]


def centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's centres of the bounded sample."""
    c = sample[np.random.default_rng(11).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = nearest_centre(sample, c)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = sample[near == j].mean(0)
    return c


def nearest_centre(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (m @ c.T * 2 - (c * c).sum(1)).argmax(1)


def fit(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centres by dimension, from a bounded sample of the classes."""
    counted = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(DIMS).collect()
    sample = rows.orderBy("h", F.col("ids")[0]).limit(SAMPLE).select("v").collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r["v"]), []).append(r["v"])
    many = lambda r: max(1, min(MOST_LISTS, int(LISTS * r["count"] ** 0.5)))
    return {r["d"]: centres(np.array(by[r["d"]]), many(r)) for r in counted if r["d"] in by}


def assign(rows: DataFrame, fitted: dict[int, np.ndarray]) -> DataFrame:
    """(grp, lst, h, ids, v): each row with its dimension and its nearest list."""

    def run(batches):
        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy(np.int64)
            lst = np.zeros(len(pdf), np.int32)
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                if int(d) in fitted:
                    lst[at] = nearest_centre(np.stack(pdf["v"].to_numpy()[at]), fitted[int(d)])
            yield pd.DataFrame({"grp": dims, "lst": lst, "h": pdf["h"], "ids": pdf["ids"], "v": pdf["v"]})

    return rows.select("h", "ids", "v").mapInPandas(run, "grp long, lst int, h long, ids array<long>, v array<double>")


def probes(q: np.ndarray, c: np.ndarray | None, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which lists each query probes: the best PROBED of them, and more until they hold k classes."""
    if c is None:
        return np.ones((len(q), 1), bool)
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1) - sizes[order]
    use = (np.arange(len(c)) < PROBED * len(c)) | (held < k)
    mask = np.zeros_like(use)
    np.put_along_axis(mask, order, use, axis=1)
    return mask


def scan(turn: np.ndarray, k: int, mask: np.ndarray, q: np.ndarray):
    """Rotated column blocks of one list block, early exits by the test, exact products for the rest."""
    dim = q.shape[1]
    rq, qq = q @ turn, (q * q).sum(1)

    def run(c, lst, theta):
        rc, cc = c @ turn, (c * c).sum(1)
        live = mask[:, lst]
        sure = np.zeros(live.shape, bool)
        first = max(2 * k, len(c) // FIRST)
        if len(c) > first and not np.isfinite(theta).all():  # a threshold from the block's first classes
            few = np.where(live[:, :first], q @ c[:first].T, -np.inf)
            own = np.partition(few, first - k, axis=1)[:, first - k]
            sure[:, :first] = few >= np.maximum(own, theta)[:, None] - SLACK * np.sqrt(qq)[:, None]
            sure &= live
            theta = np.maximum(theta, own)
        room = qq[:, None] + cc[None, :]
        reach = np.maximum(room - 2 * theta[:, None], 0) + SLACK * room
        part, near_q, near_c = np.zeros(live.shape), np.zeros(len(q)), np.zeros(len(c))
        a = b = s = None
        for d in range(0, dim, COLUMNS):
            e = min(d + COLUMNS, dim)
            near_q = near_q + (rq[:, d:e] ** 2).sum(1)
            near_c = near_c + (rc[:, d:e] ** 2).sum(1)
            # At the last column the estimate is the distance, and the test a comparison.
            grow = 1.0 if e == dim else (1 + ERROR / np.sqrt(e)) ** 2 * e / dim
            if a is None:  # whole blocks until few pairs are left
                part += rq[:, d:e] @ rc[:, d:e].T
                live &= (near_q[:, None] + near_c - 2 * part <= grow * reach) | sure
                if e == dim or np.count_nonzero(live) * SPARSE < live.size:
                    a, b = np.nonzero(live)
                    s = part[a, b]
            else:
                s = s + products(rq[:, d:e], rc[:, d:e], a, b)
                stay = (near_q[a] + near_c[b] - 2 * s <= grow * reach[a, b]) | sure[a, b]
                a, b, s = a[stay], b[stay], s[stay]
        return a, b, products(q, c, a, b)

    return run


def products(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """Inner products of the row pairs, each summed in the same order, some pairs at a time."""
    out = [np.einsum("ij,ij->i", q[a[i:i + most]], c[b[i:i + most]]) for i in range(0, len(a), most)]
    return np.concatenate(out) if out else np.zeros(0)


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows and queries as `vectors.clean` returns them."""
    n, k1 = partitions(rows.sparkSession), k + 1  # one more: the query itself
    held = keep(V.classes(rows, k1), "classes")
    fitted = fit(held)
    ranged = lambda df: df.repartitionByRange(n, "grp", "lst", "h").sortWithinPartitions("grp", "lst", "h")
    listed = keep(assign(held, fitted), "listed")
    wanted = F.col("grp").isin(list(fitted)) if fitted else F.lit(False)
    sizes = {d: np.zeros(len(c), np.int64) for d, c in fitted.items()}
    for r in listed.filter(wanted).groupBy("grp", "lst").count().collect():  # at most DIMS * MOST_LISTS
        sizes[r["grp"]][r["lst"]] = r["count"]
    blocks = keep(V.pack(ranged(listed)), "lists")
    numbered = V.asked(queries)
    asked = keep(V.pack(ranged(assign(numbered.withColumn("ids", F.array("q")), fitted))), "asked-blocks")

    def probed(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q = np.frombuffer(r.vecs, np.float64).reshape(r.n, -1)
                mask = probes(q, fitted.get(r.grp), sizes.get(r.grp), k1)
                near = np.bincount(np.frombuffer(r.lsts, np.int32), minlength=mask.shape[1])
                use = np.nonzero(mask.any(0))[0]
                yield pd.DataFrame({"qblock": r.block, "grp": r.grp, "lst": use.astype(np.int32), "prio": near[use]})

    with scope(rows.sparkSession, batch=4) as few:
        near = few.result(asked.mapInPandas(probed, "qblock string, grp long, lst int, prio long"), "probed")
    has = blocks.select("block", "grp", F.explode("has").alias("lst"))
    pairs = near.join(has, ["grp", "lst"]).groupBy("qblock", "block").agg(F.sum("prio").alias("prio"))

    def scorer(q, dim):
        return scan(rotation(dim), k1, probes(q, fitted.get(dim), sizes.get(dim), k1), q)

    return V.answers(queries, numbered, V.retrieve(pairs, asked, blocks, scorer, k1, "double"), k)


def embeddings_nearest(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest found for each row whose vec_id is divisible by `every`."""
    with scope(embeddings.sparkSession) as tables:
        rows = keep(V.clean(embeddings, zero=False), "vectors")
        return tables.result(search(rows, rows.filter(F.col("vec_id") % every == 0), k), "nearest")
