"""A Merkle manifest of the documents: an append log in postorder, proofs by closed-form positions.

Every `lang` is a tree whose leaves ascend by doc_id; eight nodes have one parent, the last run fewer.
The trees' tops, ordered by lang, are the leaves of one more tree, whose top is the root.

1. Leaves are hashed by Spark, range-partitioned by (lang, doc_id) and numbered; only the counts of
   (partition, lang) are looked at together, so a language with a third of all rows stays spread.
2. Aligned builders: the leaves 4096 k to 4096 k + 4095 of a tree go to one builder, which appends each
   node as soon as its last leaf is there. The tops of the builders are the next round's leaves, until
   every tree has one top: three rounds for 6 * 10^10 leaves.
3. In an append log a node stands behind everything that was complete before it. With e leaves there when
   node j of level l completes, of n leaves in all and height h, its position is
   sum(ceil(e / 8^i), i <= l) + sum(floor((e - 1) / 8^i), l < i <= h) - 1.
   Proof extraction computes its siblings' positions so and reads nothing else of the log; it goes from
   the root down, round by round, and a builder's part of a proof is worked out once for all its leaves.

Defined results: leaves of one (lang, doc_id) are ordered by their digests; a null doc_id comes first, is
`-` in its leaf and is not tampered with; null and empty texts differ (`-` and `0:`); an empty table has no
rows; columns beyond those hashed are ignored. Texts are only hashed by Spark, at any length.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, scope

ARITY = 8
#: Levels that one builder makes: 8^4 leaves.
LEVELS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIZE = 64  # hex digits of a digest


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def position(level, index, n, h: int):
    """Where node `index` of `level` stands in the append log of a tree of n leaves and height h. Arrays do as well."""
    e = np.minimum((index + 1) * ARITY ** level, n)
    done = sum(-(-e // ARITY ** i) for i in range(level + 1))
    return done + sum((e - 1) // ARITY ** i for i in range(level + 1, h + 1)) - 1


def build(leaves: list[str], h: int) -> list[str]:
    """The append log of a tree: each node right after its last child."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(h + 1)]

    def add(level: int, digest: str):
        log.append(digest)
        if level < h:
            open_[level].append(digest)
            if len(open_[level]) == ARITY:
                add(level + 1, _hash(open_[level]))
                open_[level] = []

    for x in leaves:
        add(0, x)
    for level in range(h):
        if open_[level]:
            add(level + 1, _hash(open_[level]))
            open_[level] = []
    return log


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def siblings(log: str, i: int, n: int, h: int) -> list[tuple[str, str]]:
    """For leaf i, level by level up: the digests before and after its own node in the run, read from the log."""
    out = []
    for level in range(h):
        at = i // ARITY ** level
        first = at - at % ARITY
        end = min(first + ARITY, -(-n // ARITY ** level))
        read = [log[p * _SIZE:(p + 1) * _SIZE] for p in (int(position(level, j, n, h)) for j in range(first, end))]
        out.append(("".join(read[:at - first]), "".join(read[at - first + 1:])))
    return out


def fold(digest: str, proof: list[tuple[str, str]]) -> str:
    """The top that follows from a leaf and its siblings."""
    for before, after in proof:
        digest = _hash([before, digest, after])
    return digest


def field(name: str, value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(c, text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """`rows` with `at`, counted from 0 in each tree by `order`, and `n`, the tree's rows. Trees may span many partitions."""
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    # Written before it is used: the numbers then hold whatever is lost later.
    ranged = keep(ranged.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", 33)), name)
    here = ranged.groupBy("part", tree).agg(F.count("*").alias("rows"), F.min("seq").alias("least"))
    w = Window.partitionBy(tree).orderBy("part")  # at most one row for each partition
    here = here.select("part", tree, "least",
                       (F.sum("rows").over(w) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy(tree)).alias("n"))
    return ranged.join(here, ["part", tree]).withColumn("at", F.col("seq") - F.col("least") + F.col("before")).drop("seq", "part", "least", "before")


_LOG = "tree string, chunk long, at long, start long, n long, total long, level int, log string, top string"


def _builder(level: int, levels: int):
    """Builders of one round: a group holds the nodes of `level` below one node `levels` higher."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        total, count = int(pdf["n"].iloc[0]), len(pdf)
        whole = height(total)
        h = max(0, min(levels, whole - level))
        log = build(list(pdf["digest"]), h)
        chunk = int(pdf["at"].iloc[0]) // ARITY ** levels
        # The segment's first node in the whole tree's log; at higher levels the log goes on between its nodes.
        start = int(position(min(level, whole), chunk * ARITY ** levels, total, whole))
        return pd.DataFrame([(pdf["tree"].iloc[0], chunk, chunk, start, count, total, level, "".join(log), log[-1])],
                            columns=[c.split(" ")[0] for c in _LOG.split(", ")])

    return run


def manifest(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Segments of the append logs by round, for leaves (tree, at, n, digest). The last round has a row for each tree."""
    rounds, level = [], 0
    while True:
        chunked = leaves.select("tree", "at", "n", "digest", F.floor(F.col("at") / ARITY ** levels).alias("chunk"))
        made = chunked.groupBy("tree", "chunk").applyInPandas(_builder(level, levels), _LOG)
        rounds.append(keep(made, f"log{level}"))
        if rounds[-1].filter("total > %d" % ARITY ** (level + levels)).isEmpty():
            return rounds
        level += levels
        # Trees that have their top already are carried along: their height is reached, a builder hands the leaf on.
        leaves = rounds[-1].select("tree", F.col("chunk").alias("at"), F.col("total").alias("n"), F.col("top").alias("digest"))


_PROOF = "array<struct<before:string,after:string>>"


def _below(levels: int):
    """The leaves of segments with their proofs: their own siblings, then those of the segment's top."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                above = [(x["before"], x["after"]) for x in r.proof]
                h = max(0, min(levels, height(int(r.total)) - int(r.level)))
                proofs = [siblings(r.log, i, int(r.n), h) + above for i in range(int(r.n))]
                yield pd.DataFrame({"tree": r.tree, "chunk": np.arange(r.n, dtype=np.int64) + r.chunk * ARITY ** levels,
                                    "proof": [[{"before": a, "after": b} for a, b in p] for p in proofs]})

    return run


def segment_proofs(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """(tree, chunk, proof) of the lowest round's segments: the siblings above each segment's top.

    tops: (tree, proof), the siblings above each tree's top.
    """
    proofs = tops.select("tree", F.lit(0).cast("long").alias("chunk"), "proof")
    for log in reversed(rounds[1:]):
        both = log.join(proofs, ["tree", "chunk"]).select("tree", "chunk", "n", "total", "level", "log", "proof")
        proofs = keep(both.mapInPandas(_below(levels), f"tree string, chunk long, proof {_PROOF}"), "proofs")
    return proofs


def _proved(levels: int):
    """The documents of a segment: proof digests, and the root that follows from each tampered leaf."""

    def run(key: tuple, rows: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        r = segment.iloc[0]
        above = [(x["before"], x["after"]) for x in r["proof"]]
        rest, n = "".join(a + b for a, b in above), int(r["n"])
        h = min(levels, height(int(r["total"])))
        out = []
        for doc_id, at, digest, changed in zip(rows["doc_id"], rows["at"], rows["digest"], rows["changed"], strict=True):
            own = siblings(r["log"], int(at) - int(r["chunk"]) * ARITY ** levels, n, h)
            out.append((doc_id, digest, r["subroot"], _hash([*[a + b for a, b in own], rest]), fold(changed, own + above)))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return run


def prove(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each document row."""
    with scope(docs.sparkSession, batch=64) as kept:
        doc_id = F.col("doc_id").cast("long")
        hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
        tree = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "lang"))
        lower = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
        rows = docs.select(tree.alias("tree"), doc_id.alias("doc_id"), leaf(F.col("text")).alias("digest"), leaf(lower).alias("changed"))
        hashed = keep(rows, "hashed")
        rows = keep(numbered(hashed, "tree", ["doc_id", "digest"], "sorted").withColumn("chunk", F.floor(F.col("at") / ARITY ** levels)), "leaves")
        kept.free(hashed)
        rounds = manifest(rows, levels)
        subroots = rounds[-1].select(F.lit("root").alias("of"), F.col("tree").alias("lang"), F.col("top").alias("digest"))
        subroots = keep(numbered(subroots, "of", ["lang"], "subroots"), "tops")
        above = manifest(subroots.select(F.col("of").alias("tree"), "at", "n", "digest"), levels)
        up = segment_proofs(above, docs.sparkSession.range(1).select(F.lit("root").alias("tree"), F.array().cast(_PROOF).alias("proof")), levels)
        both = above[0].join(up, ["tree", "chunk"]).select("tree", "chunk", "n", "total", "level", "log", "proof")
        up = both.mapInPandas(_below(levels), f"tree string, chunk long, proof {_PROOF}").select(F.col("chunk").alias("at"), "proof")
        tops = keep(subroots.join(up, "at").select(F.col("lang").alias("tree"), "proof"), "toplists")
        down = segment_proofs(rounds, tops, levels)
        logs = rounds[0].join(down, ["tree", "chunk"]).join(subroots.select(F.col("lang").alias("tree"), F.col("digest").alias("subroot")), "tree")
        logs = logs.select("tree", "chunk", "n", "total", "log", "proof", "subroot")
        # Ids as text: pandas has no nulls among integers.
        rows = rows.select("tree", "chunk", F.col("doc_id").cast("string").alias("doc_id"), "at", "digest", "changed")
        out = rows.groupBy("tree", "chunk").cogroup(logs.groupBy("tree", "chunk")).applyInPandas(
            _proved(levels), "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string")
        out = out.crossJoin(F.broadcast(above[-1].select(F.col("top").alias("root"))))  # one row
        return kept.result(out.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                                      (F.col("folded_root") == F.col("root")).alias("verified")))


def sql() -> str:
    """The same by recursion over levels, for DuckDB."""
    def enc(x):
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"

    def h(text):
        return f"sha256({' || '.join(enc(text if c == 'text' else c) for c in FIELDS)})"

    return f"""
    WITH RECURSIVE hashed AS (
        SELECT row_number() OVER () AS r, doc_id, lang, {h('text')} AS leaf,
            CASE WHEN {CRC32.format(x='doc_id')} % 3 = 0 THEN {h(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {h('text')} END AS changed
        FROM documents),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
    tree AS (
        SELECT lang, 0 AS lvl, i, n, leaf AS d FROM leaves
        UNION ALL
        SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 8, n),
    tops AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
    peak AS (
        SELECT 0 AS lvl, i, n, d FROM tops
        UNION ALL
        SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM peak WHERE n > 1 GROUP BY lvl, i // 8, n),
    steps AS (
        SELECT x.r, t.lvl, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < x.i // (8 ** t.lvl)::BIGINT), '') AS a,
            coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > x.i // (8 ** t.lvl)::BIGINT), '') AS b
        FROM leaves x JOIN tree t ON t.lang IS NOT DISTINCT FROM x.lang AND t.n > 1 AND t.i // 8 = x.i // (8 ** (t.lvl + 1))::BIGINT
        GROUP BY x.r, t.lvl
        UNION ALL
        SELECT x.r, 1000 + t.lvl, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < s.i // (8 ** t.lvl)::BIGINT), ''),
            coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > s.i // (8 ** t.lvl)::BIGINT), '')
        FROM leaves x JOIN tops s ON s.lang IS NOT DISTINCT FROM x.lang JOIN peak t ON t.n > 1 AND t.i // 8 = s.i // (8 ** (t.lvl + 1))::BIGINT
        GROUP BY x.r, t.lvl),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k FROM steps),
    folds AS (
        SELECT r, 0::BIGINT AS k, changed AS d FROM leaves
        UNION ALL
        SELECT f.r, s.k, sha256(s.a || f.d || s.b) FROM folds f JOIN numbered s ON s.r = f.r AND s.k = f.k + 1),
    done AS (SELECT r, arg_max(d, k) AS folded_root FROM folds GROUP BY r),
    proofs AS (SELECT r, string_agg(a || b, '' ORDER BY k) AS p FROM numbered GROUP BY r),
    root AS (SELECT d AS root FROM peak WHERE n = 1)
    SELECT x.doc_id, x.leaf, s.d AS subroot, root.root, sha256(coalesce(p.p, '')) AS proof_sha256, f.folded_root, f.folded_root = root.root AS verified
    FROM leaves x JOIN tops s ON s.lang IS NOT DISTINCT FROM x.lang JOIN done f ON f.r = x.r LEFT JOIN proofs p ON p.r = x.r, root"""


#: crc32 of a value's decimal text: bytes in turn, eight bits each.
CRC32 = ("xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({x}::VARCHAR, ''), lambda s: ascii(s)::BIGINT), "
         "lambda c, x: list_reduce([xor(c, x)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)")
