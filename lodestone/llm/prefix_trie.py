"""A trie of conversations by common first turns, from vertical bitmaps.

1. A conversation is one row: the 128-bit digests and word counts of its turns, in order.
2. Conversations are range-partitioned by their digests and then their ids, and numbered; SHARD
   neighbours make a shard. So copies of one conversation, however many, are spread over shards, and
   members of a node stand side by side.
3. A shard indexes (position, turn) to a bitset of its conversations. Depth first, a node's bitset is
   intersected with the postings at the next position: the child that holds the first conversation
   left, then the next one. Popcounts are members, bits whose conversation is over are ends.
   Positions that no two neighbours share need no postings: a lone conversation's tail is a chain.
4. Nodes that reach over a shard's border are put together by their digest from one row a shard. A
   shard knows its neighbours' adjoining conversations, so a node is counted as somebody's child and by
   its words in the first of its shards only, and as childless in the last one. All else adds up.

SHA-256 needs a node's end ids in order, and shards hold them in order: those of a node over many
shards are streamed as packed runs, never held together.

Defined results: rows with a null conv_id belong to no conversation; turns of one number (or several
null ones) are ordered by the MD5 digests of role and text; repeated rows are repeated turns; an empty
table has no nodes, not even a root; other columns are ignored. Texts are only hashed and counted by
Spark, at any length; a conversation's turns take 20 bytes each in one row.
"""

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, partitions, scope

#: Conversations of a shard; a bitset has so many bits.
SHARD = 4096
#: A conversation's head comes from the last one whose id this divides; at most HEAD - 1 turns of it.
EVERY, HEAD = 20, 4
#: Most rows that a shard hands on at once.
_ROWS = 20_000

_NODE = ("closed boolean, key binary, parent binary, conv_id long, depth int, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, weighted long, own_words long, ends_sha256 string, shard long, ends string")
_COLUMNS = [c.split(" ")[0] for c in _NODE.split(", ")]


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, words): each conversation's turns in order as digests and word counts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))
    turn = F.col("turn").cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), digest.alias("digest"), words.alias("words")).alias("t"))
    rows = rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.col("t.digest").alias("seq"), F.col("t.words").alias("words"))


def rebuilt(convs: DataFrame, every: int = EVERY) -> DataFrame:
    """Conversations whose first h turns are those of the last conversation whose id `every` divides; h is crc32(id) % HEAD."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    base = convs.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("seq", 1, HEAD - 1).alias("base_seq"), F.slice("words", 1, HEAD - 1).alias("base_words"))
    rows = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(base, "base", "left")
    both = lambda own, head: F.concat(
        F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.slice(own, 1, 0)),
        F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0))))
    return rows.select("conv_id", both("seq", "base_seq").alias("seq"), both("words", "base_words").alias("words"))


def sharded(rows: DataFrame, size: int) -> DataFrame:
    """(shard, at, conv_id, seq, words) in order of seq and id; each shard also has its two neighbours' adjoining rows."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    ranged = keep(ranged.withColumn("row", F.monotonically_increasing_id()), "ordered")
    here = ranged.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("rows"))
    here = here.withColumn("before", F.expr("sum(rows) OVER (ORDER BY part) - rows"))  # one row for each partition
    at = ranged.withColumn("part", F.shiftright("row", 33)).join(here, "part")
    at = at.select((F.col("row").bitwiseAND(F.lit(2 ** 33 - 1)) + F.col("before")).alias("at"), "conv_id", "seq", "words")
    shard = F.floor(F.col("at") / size)
    return at.select(F.explode(F.array_distinct(F.array(shard, F.floor((F.col("at") - 1) / size), F.floor((F.col("at") + 1) / size)))).alias("shard"),
                     "at", "conv_id", "seq", "words").filter("shard >= 0")


def _common(a, b) -> int:
    """Turns that two conversations begin with alike."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class _Shard:
    """Nodes of one shard, in no particular order, as lists of column values."""

    def __init__(self, shard: int, ids, seqs, words, before, after):
        self.shard, self.ids, self.seqs, self.words = shard, ids, seqs, words
        #: Depth to which the path of the first (last) conversation is shared with the shard before (after).
        self.low = _common(before, seqs[0]) if before is not None else -1
        self.high = _common(seqs[-1], after) if after is not None else -1
        m = len(ids)
        near = [_common(seqs[i], seqs[i + 1]) for i in range(m - 1)]
        shared = [max(a, b) for a, b in zip([0, *near], [*near, 0], strict=True)]
        self.postings: dict[tuple[int, bytes], int] = {}
        for i, s in enumerate(seqs):
            bit = 1 << i
            for d in range(min(len(s), shared[i] + 1)):
                k = (d, s[d])
                self.postings[k] = self.postings.get(k, 0) | bit
        self.over: dict[int, int] = {}
        for i, s in enumerate(seqs):
            self.over[len(s)] = self.over.get(len(s), 0) | 1 << i

    def nodes(self):
        """Rows, children before their parents."""
        m = len(self.ids)
        everyone = (1 << m) - 1
        key = hashlib.blake2b(b"root", digest_size=16).digest()
        # bitset, depth, key, parent's key and id, open parent, words; then what the subtree sums to, and who is left.
        stack = [[everyone, 0, key, None, None, False, 0, [0, 0, 0, 0], None]]
        while stack:
            top = stack[-1]
            bits, depth, key, parent, parent_conv, parent_open, words, sums, left = top
            if left is None:
                ends = bits & self.over.get(depth, 0)
                top[8] = left = bits & ~ends
            if left:
                i = (left & -left).bit_length() - 1
                turn = self.seqs[i][depth]
                child = left & self.postings[depth, turn] if left & left - 1 else left
                top[8] = left & ~child
                spans = self._spans(bits, depth)
                stack.append([child, depth + 1, hashlib.blake2b(key + turn, digest_size=16).digest(), key if spans else None,
                              None if spans else min(self.members(bits)), spans, int(self.words[i][depth]), [0, 0, 0, 0], None])
                continue
            stack.pop()
            row, up = self._row(bits, depth, key, parent, parent_conv, words, sums)
            if stack:
                for j, x in enumerate(up):
                    stack[-1][7][j] += x
            yield row

    def members(self, bits: int):
        while bits:
            low = bits & -bits
            yield self.ids[low.bit_length() - 1]
            bits ^= low

    def _spans(self, bits: int, depth: int) -> bool:
        return bool(bits & 1 and depth <= self.low or bits >> len(self.ids) - 1 and depth <= self.high)

    def _row(self, bits, depth, key, parent, parent_conv, words, sums):
        n, ends = bits.bit_count(), bits & self.over.get(depth, 0)
        first = not (bits & 1 and depth <= self.low)
        last = not (bits >> len(self.ids) - 1 and depth <= self.high)
        spans = not (first and last)
        leaves, weighted, own, children = sums
        # The members' order puts those that end here first, so the last one tells whether anybody goes on.
        leaves += last and ends == bits
        weighted += n * words
        own += words if first else 0
        listed = ",".join(map(str, sorted(self.members(ends)))) if ends else ""
        row = (not spans, key if spans else None, parent, min(self.members(bits)), depth, parent_conv, n, children, leaves, weighted, own,
               None if spans else hashlib.sha256(listed.encode()).hexdigest(), self.shard, listed if spans else None)
        return row, (leaves, weighted, own, int(first))


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"parent_conv_id": "Int64"})


def _tries(size: int):
    """Nodes of shards whose rows follow each other in a partition."""

    def made(rows):
        shard = rows[0][0]
        own = [r for r in rows if r[1] // size == shard]
        if not own:  # only the last conversation of all, as a neighbour
            return
        before = next((r[3] for r in rows if r[1] < shard * size), None)
        after = next((r[3] for r in rows if r[1] >= (shard + 1) * size), None)
        out = []
        for row in _Shard(shard, *(list(x) for x in zip(*(r[2:] for r in own), strict=True)), before, after).nodes():
            out.append(row)
            if len(out) == _ROWS:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    def run(batches):
        held: list = []
        for pdf in batches:
            for r in zip(pdf["shard"], pdf["at"], pdf["conv_id"], pdf["seq"], pdf["words"], strict=True):
                if held and held[0][0] != r[0]:
                    yield from made(held)
                    held = []
                held.append(r)
        if held:
            yield from made(held)

    return run


def _hashed(batches):
    """(key, ends_sha256) from runs of ids in order of key and shard; one run is in memory at a time."""
    key, state, some = None, None, False
    for pdf in batches:
        for k, ends in zip(pdf["key"], pdf["ends"], strict=True):
            if k != key:
                if key is not None:
                    yield pd.DataFrame({"key": [key], "ends_sha256": [state.hexdigest()]})
                key, state, some = k, hashlib.sha256(), False
            if ends:
                state.update((("," if some else "") + ends).encode())
                some = True
    if key is not None:
        yield pd.DataFrame({"key": [key], "ends_sha256": [state.hexdigest()]})


def trie(convs: DataFrame, size: int = SHARD) -> DataFrame:
    """The nodes for conversations (conv_id, seq, words), conv_id unique."""
    spark = convs.sparkSession
    n = partitions(spark)
    with scope(spark, batch=512) as kept:
        rows = sharded(convs, size)
        parts = keep(rows.repartition(n, "shard").sortWithinPartitions("shard", "at").mapInPandas(_tries(size), _NODE), "parts")
        open_ = parts.filter("NOT closed")
        ends = open_.select("key", "shard", "ends").repartition(n, "key").sortWithinPartitions("key", "shard")
        ends = ends.mapInPandas(_hashed, "key binary, ends_sha256 string")
        sums = ["n_convs", "n_children", "n_leaves", "weighted", "own_words"]
        merged = open_.groupBy("key").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
                                          *[F.sum(c).alias(c) for c in sums])
        merged = keep(merged.join(ends, "key"), "merged")
        found = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
        above = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        inside = parts.filter("closed AND parent IS NULL").select(*found)
        below = parts.filter("closed AND parent IS NOT NULL").drop("parent_conv_id").join(above, "parent").select(*found)
        border = merged.join(above, "parent", "left").select(*found)
        out = inside.unionByName(below).unionByName(border)
        return kept.result(out.select(
            "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
            (F.col("weighted") - F.col("own_words")).alias("saved_tokens"), "ends_sha256"))


def nodes(turns: DataFrame, size: int = SHARD) -> DataFrame:
    """The trie of the rebuilt conversations in (conv_id, turn, role, text)."""
    with scope(turns.sparkSession) as kept:
        return kept.result(trie(rebuilt(keep(conversations(turns), "conversations")), size))


def sql() -> str:
    """The same for DuckDB: nodes are distinct prefixes, kept as lists."""
    from .merkle import CRC32

    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    own AS (
        SELECT conv_id, list(strlen(role) || ':' || role || text ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS t,
            list(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS w,
            {CRC32.format(x='conv_id')} % {HEAD} AS h
        FROM turns GROUP BY conv_id),
    whole AS (
        SELECT o.conv_id, coalesce(b.t[1:o.h], []) || o.t[o.h + 1:] AS t, coalesce(b.w[1:o.h], []) || o.w[o.h + 1:] AS w
        FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {EVERY}),
    prefixes AS (SELECT conv_id, d, sha256(array_to_string(list_transform(t[1:d], lambda x: sha256(x)), '')) AS k, len(t) AS n,
            CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(t[1:d - 1], lambda x: sha256(x)), '')) END AS up, w[d] AS words
        FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM whole)),
    node AS (
        SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words,
            sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
        FROM prefixes GROUP BY d, k),
    children AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
    -- A node's first member passes through all that is above it.
    held AS (
        SELECT p.d, p.k, sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens, count(*) FILTER (c.n IS NULL) AS n_leaves
        FROM node x LEFT JOIN children c ON c.d = x.d AND c.k = x.k JOIN prefixes p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY p.d, p.k)
    SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children, h.n_leaves, h.saved_tokens, x.ends_sha256
    FROM node x JOIN held h ON h.d = x.d AND h.k = x.k LEFT JOIN children c ON c.d = x.d AND c.k = x.k
        LEFT JOIN node p ON p.d = x.d - 1 AND p.k = x.up"""
