"""N-gram Jaccard join by prefix trees, and the groups that its links form.

1. Every document's set of 5-word shingles is hashed to 64 bits; equal sets are one class.
2. A task packs the shingles of a batch of documents by hash range, compressed. Each range tells how
   many of a batch's shingles occur in another set, so a set with too few shared shingles for any
   partner is out, without its shingles being listed as rows.
3. The sets that stay are ordered globally, rare shingles first. Two sets that link share one of
   their first n - ceil(0.8 n) + 1 shingles.
4. Large groups of near copies are joined cheaply first: a set is compared with one set of the longest
   of its posting lists, twice with another one, then with one set of each of its lists. Members of one
   group need no comparison for the groups to be right.
5. Each list that still holds several groups is a prefix tree of its globally ordered sets in a task,
   which each of them traverses once: along a shared path the overlap is counted once for all that
   follow it, and a subtree is left when the overlap so far plus the largest length that remains below
   it is too small for the shortest set there, or when no length below fits. Only links that join two
   groups leave the task, so a list of sets that do not link yields nothing. A list with more than
   CHUNK shingles is cut into chunks by set, and each two chunks meet in one task.

Defined results: null or blank text has an empty set and links with nothing; repeated rows form one
group; rows of one doc_id with different texts are grouped by their texts; a null doc_id takes no
part and has a null component; other columns are ignored.
"""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOOM, keep, mix64, partitions, pieces_of, row_key, scope, semi

WORDS = 5
PERCENT = 80
#: Shingles of a list's chunk.
CHUNK = 1 << 20
#: Leaves of one node that are looked at together.
FAN = 8
#: Rounds in which a set is compared with one set of its longest list, and with one set of each list.
NARROW, WIDE = 2, 1

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SHORT = np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Shingle hashes of texts; words that were seen are remembered, up to a bound."""

    def __init__(self, most: int = 100_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def words(self, text: str) -> list[int]:
        import xxhash

        known, out = self.known, []
        for w in text.encode("utf-8", "replace").lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        if len(known) > self.most:
            known.clear()
        return out

    def sets(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document position, hash), distinct and sorted, and the set sizes."""
        words = [self.words(t or "") for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        x = np.array([h for w in words for h in w], np.uint64)
        doc = np.repeat(np.arange(len(words)), sizes)
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(x) >= WORDS:
            last = len(x) - WORDS + 1
            h = sum(x[i:last + i] * _C[i] for i in range(WORDS))
            inside = doc[:last] == doc[WORDS - 1:]
            h, d = h[inside], doc[:last][inside]
        few = np.nonzero((sizes > 0) & (sizes < WORDS))[0]
        if len(few):
            short = [sum(int(w) * int(c) for w, c in zip(words[i], _C, strict=False)) + int(_SHORT) * len(words[i]) & (2 ** 64 - 1) for i in few]
            h, d = np.concatenate([h, np.array(short, np.uint64)]), np.concatenate([d, few])
        h = mix64(h)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[first], d[first]
        return d, h, np.bincount(d, minlength=len(words))


def set_ids(doc: np.ndarray, h: np.ndarray, n: int) -> list[str]:
    """A 128-bit name of each set: sums of its hashes, remixed twice."""
    out = []
    for salt in (np.uint64(1), np.uint64(0x9FB21C651E98DF25)):
        total = np.zeros(n, np.uint64)
        np.add.at(total, doc, mix64(h ^ salt))
        out.append(total)
    return [f"{a:016x}{b:016x}" for a, b in zip(*out, strict=True)]


def _size(row):
    return len(row.text or "")


def _profile(batches):
    shingler = Shingler()
    for pdf in pieces_of(batches, _size, 2 << 20):
        doc, h, n = shingler.sets(pdf["text"])
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "set_id": set_ids(doc, h, len(pdf)), "n": n})


# Sets with enough shared shingles

def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array by significance, which compresses better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes, kind, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


_MANY = 0xFFFF


def _packer(shards: int):
    def run(batches):
        import zstandard
        from pyspark import TaskContext

        part, made, press, shingler = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1), Shingler()
        for pdf in pieces_of(batches, _size, 3 << 20):
            doc, h, n = shingler.sets(pdf["text"])
            names = set_ids(doc, h, len(pdf))
            first = {}
            for i, s in enumerate(names):
                first.setdefault(s, i)
            once = np.zeros(len(pdf), bool)
            once[list(first.values())] = True
            at = once[doc]
            doc, h = doc[at], h[at]
            order = np.argsort(h >> np.uint64(24), kind="stable")
            doc, key = doc[order], h[order] >> np.uint64(24)
            u, start, count = np.unique(key, return_index=True, return_counts=True)
            many = count > 1
            local = np.bincount(doc[np.repeat(many, count)], minlength=len(pdf))
            owner = np.where(many, _MANY, doc[start]).astype(np.uint16)
            shard = ((u >> np.uint64(8)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(shard, np.arange(shards + 1))
            made += 1
            head = "\n".join(f"{s} {n[i]} {local[i]} {i}" for s, i in first.items())
            rows = []
            for k in range(shards):
                a, b = ends[k], ends[k + 1]
                if a < b or k == 0:
                    data = _planes(np.diff(u[a:b].astype(np.int64), prepend=0)) + _planes(owner[a:b])
                    rows.append((f"{part}-{made}", k, int(b - a), len(pdf), press.compress(data), head if k == 0 else None))
            yield pd.DataFrame(rows, columns=["batch", "shard", "n", "docs", "data", "head"])

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each batch: how many of each document's shingles (of one hash range) other batches have too."""
    import zstandard

    undo, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    data = [undo.decompress(d) for d in pdf["data"]]
    keys = [np.cumsum(_unplanes(d, np.int64, n, 0)) for d, n in zip(data, pdf["n"], strict=True)]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for d, key, r in zip(data, keys, pdf[["batch", "n", "docs", "head"]].itertuples(index=False), strict=True):
        owner = _unplanes(d, np.uint16, r.n, 8 * r.n)
        at = np.searchsorted(twice, key)
        hit = (at < len(twice)) & (owner != _MANY)
        hit[hit] = twice[at[hit]] == key[hit]
        count = np.bincount(owner[hit], minlength=r.docs).astype(np.uint32)
        out.append((r.batch, press.compress(_planes(count)), r.docs, r.head))
    return pd.DataFrame(out, columns=["batch", "counts", "docs", "head"])


def _likely(pdf: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    undo = zstandard.ZstdDecompressor()
    total = sum(_unplanes(undo.decompress(c), np.uint32, n, 0).astype(np.int64) for c, n in zip(pdf["counts"], pdf["docs"], strict=True))
    head = next(h for h in pdf["head"] if h is not None)
    rows = [x.split(" ") for x in head.split("\n") if x]
    out = [s for s, n, local, i in rows if int(n) and 100 * (int(local) + int(total[int(i)])) >= PERCENT * int(n)]
    return pd.DataFrame({"set_id": pd.Series(out, dtype=object)})


def likely_sets(docs: DataFrame) -> DataFrame:
    """(set_id) of the sets enough of whose shingles some other row has."""
    shards = partitions(docs.sparkSession)
    packed = docs.select("text").mapInPandas(_packer(shards), "batch string, shard int, n int, docs int, data binary, head string")
    counts = packed.groupBy("shard").applyInPandas(_shared, "batch string, counts binary, docs int, head string")
    return counts.groupBy("batch").applyInPandas(_likely, "set_id string").distinct()


# Candidates

def _members(batches):
    shingler = Shingler()
    for pdf in pieces_of(batches, _size, 1 << 20):
        doc, h, n = shingler.sets(pdf["text"])
        ends = np.concatenate([[0], np.cumsum(n)])
        yield pd.DataFrame({"set_id": set_ids(doc, h, len(pdf)), "n": n,
                            "h": [h[ends[i]:ends[i + 1]].view(np.int64) for i in range(len(pdf))]})


def _least(n):
    """The smallest overlap of a set of n with a partner: ceil(0.8 n)."""
    return F.ceil(n * PERCENT / 100.0 - 1e-9).cast("int")


def ordered_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(sid, n, first, shared): shared shingles of each set, rare first, and how many may be its first match."""
    rows = semi(docs, reps.select("doc_id")).select("text").mapInPandas(_members, "set_id string, n int, h array<long>")
    rows = rows.join(reps.select("set_id", "sid"), "set_id").dropDuplicates(["sid"]).select("sid", "n", "h")
    with scope(docs.sparkSession) as kept:
        return kept.result(_ordered(keep(rows, "members")), "sets")


def _ordered(rows: DataFrame) -> DataFrame:
    flat = rows.select("sid", F.explode("h").alias("tok"))
    df = flat.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    lists = flat.join(df, "tok").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("l"))  # one set's shingles
    out = lists.join(rows.select("sid", "n"), "sid").filter(F.size("l") >= _least(F.col("n")))
    own = F.col("n") - F.size("l")
    out = out.select("sid", "n", own.alias("own"), (F.col("n") - _least(F.col("n")) + 1 - own).alias("first"),
                     F.transform("l", lambda x: x["tok"]).alias("toks"))
    return out.filter("first > 0")


def _overlaps(batches):
    """Links among rows (a, na, ta, b, nb, tb): the partners of each a are walked as a prefix tree."""
    for pdf in batches:
        out = []
        for a, rows in pdf.groupby("a", sort=False):
            na = int(rows["na"].iloc[0])
            own = np.sort(np.asarray(rows["ta"].iloc[0], np.int64))
            # Common shingles first, so that sets share long paths.
            paths = sorted(((np.asarray(t, np.int64)[::-1], int(b), int(nb)) for t, b, nb in zip(rows["tb"], rows["b"], rows["nb"], strict=True)),
                           key=lambda x: x[0].tobytes())
            before, seen = np.zeros(0, np.int64), np.zeros(1, np.int64)
            for path, b, nb in paths:
                need = -(-PERCENT * (na + nb) // (100 + PERCENT))
                m = min(len(before), len(path))
                differ = np.nonzero(before[:m] != path[:m])[0]
                m = int(differ[0]) if len(differ) else m
                m = min(m, len(seen) - 1)
                if seen[m] + len(path) - m >= need and len(own) >= need:
                    rest = path[m:]
                    at = np.searchsorted(own, rest)
                    hit = np.zeros(len(rest), np.int64)
                    ok = at < len(own)
                    hit[ok] = own[at[ok]] == rest[ok]
                    seen = np.concatenate([seen[:m + 1], seen[m] + np.cumsum(hit)])
                    before = path
                    if seen[-1] >= need:
                        out.append((a, b))
                # A path that is left keeps the counts of the last one walked; what it shares with that still holds.
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


class Tree:
    """A prefix tree over sorted paths; a node is a run of shingles that all sets below it share."""

    def __init__(self, paths: list[np.ndarray], sizes: list[int]):
        order = sorted(range(len(paths)), key=lambda i: tuple(paths[i][:16].tolist()))  # long equal beginnings are sorted below
        self.nodes: list[tuple] = []
        self.root = self._grow([(i, paths[i], sizes[i]) for i in order], 0)
        #: Nodes with many leaves below them look at these together.
        self.fans = {}
        for k, node in enumerate(self.nodes):
            leaves = [c for c in node[5] if not self.nodes[c][5]]
            if len(leaves) >= FAN:
                self.fans[k] = self._fan(leaves)
                node[5][:] = [c for c in node[5] if self.nodes[c][5]]

    def _grow(self, rows, depth: int) -> int:
        """Add the node of rows that agree up to `depth`; children by their next shingle. The stack is explicit."""
        top = len(self.nodes)
        todo = [(rows, depth, None)]
        while todo:
            rows, at, parent = todo.pop()
            end = self._shared(rows, at)
            here = [i for i, p, _ in rows if len(p) == end]
            node = (rows[0][1][at:end], max(len(p) for _, p, _ in rows) - end, min(n for *_, n in rows), max(n for *_, n in rows), here, [])
            self.nodes.append(node)
            if parent is not None:
                self.nodes[parent][5].append(len(self.nodes) - 1)
            me, below = len(self.nodes) - 1, {}
            for r in rows:
                if len(r[1]) > end:
                    below.setdefault(int(r[1][end]), []).append(r)
            todo += [(group, end, me) for group in below.values()]
        return top

    def _fan(self, leaves: list[int]):
        """Leaves of one node at once: which of them has a shingle, their rows and sizes."""
        rows, sizes, tokens, at = [], [], [], []
        for k in leaves:
            run, _, least, most, here, _ = self.nodes[k]
            for i in here:
                tokens.append(run)
                at.append(np.full(len(run), len(rows)))
                rows.append(i)
                sizes.append(most)
        tokens, at = np.concatenate(tokens), np.concatenate(at)
        order = np.argsort(tokens, kind="stable")
        known, first = np.unique(tokens[order], return_index=True)
        return known, np.append(first, len(tokens)), at[order], np.array(rows), np.array(sizes)

    @staticmethod
    def _shared(rows, at: int) -> int:
        first, end = rows[0][1], min(len(p) for _, p, _ in rows)
        for _, p, _ in rows[1:]:
            differ = np.nonzero(first[at:end] != p[at:end])[0]
            if len(differ):
                end = at + int(differ[0])
        return end

    def partners(self, own: np.ndarray, n: int, wanted):
        """Rows whose set links with the sorted shingles `own` of a set of n, among those that wanted() accepts."""
        todo = [(self.root, 0)]
        while todo:
            k, overlap = todo.pop()
            run, rest, least, most, here, below = self.nodes[k]
            if PERCENT * n > 100 * most or PERCENT * least > 100 * n:
                continue
            need = -(-PERCENT * (n + max(least, -(-PERCENT * n // 100))) // (100 + PERCENT))
            if overlap + len(run) + rest < need:
                continue
            at = np.searchsorted(own, run)
            at[at == len(own)] = 0
            overlap += int((own[at] == run).sum()) if len(own) else 0
            if overlap + rest < need:
                continue
            yield from ((i, overlap) for i in here if wanted(i))
            todo += [(c, overlap) for c in below]
            if k in self.fans and len(own):
                known, first, leaf, rows, sizes = self.fans[k]
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                at = at[known[at] == own]
                all_ = np.full(len(rows), overlap)
                if len(at):
                    all_ += np.bincount(np.concatenate([leaf[first[x]:first[x + 1]] for x in at]), minlength=len(rows))
                for x in np.nonzero(all_ * (100 + PERCENT) >= PERCENT * (n + sizes))[0]:
                    if wanted(int(rows[x])):
                        yield int(rows[x]), int(all_[x])


def _joined(rows: list[tuple], left: int, right: int) -> list[tuple[int, int]]:
    """Links that join groups among the sets (sid, comp, n, chunk, toks) of one list, or between two chunks of it."""
    sid, comp, sizes, chunk, paths = zip(*rows, strict=True)
    # Groups that links join in this task; a pair within one needs no comparison.
    up = {c: c for c in comp}

    def top(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    into = [i for i in range(len(paths)) if chunk[i] == right]
    out = []
    if not into or len(up) == 1:
        return out
    tree = Tree([paths[i] for i in into], [sizes[i] for i in into])
    # Of two groups one is not the largest; within one chunk that one asks.
    largest = Counter(comp).most_common(1)[0][0]
    for q in range(len(paths)):
        if chunk[q] != left or left == right and comp[q] == largest:
            continue
        other = lambda i: top(comp[into[i]]) != top(comp[q])  # noqa: B023, E731
        for i, overlap in tree.partners(np.sort(paths[q]), sizes[q], other):
            b = into[i]
            if overlap * (100 + PERCENT) >= PERCENT * (sizes[q] + sizes[b]) and top(comp[b]) != top(comp[q]):
                up[top(comp[b])] = top(comp[q])
                out.append((sid[q], sid[b]))
    return out


def _list_links(batches):
    """Lists whose rows follow each other in a partition, one in memory at a time."""
    key, rows = None, []
    for pdf in batches:
        out = []
        for tok, left, right, sid, comp, n, chunk, toks in pdf.itertuples(index=False):
            if (tok, left, right) != key:
                if rows:
                    out += _joined(rows, *key[1:])
                key, rows = (tok, left, right), []
            rows.append((sid, comp, n, chunk, np.asarray(toks, np.int64)))
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    if rows:
        yield pd.DataFrame(_joined(rows, *key[1:]), columns=["a", "b"]).astype("int64")


def list_links(entries: DataFrame, sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between groups among entries (tok, sid, comp) of posting lists."""
    s = sets.select("sid", "n", "toks")
    rows = entries.select("tok", "sid", "comp").join(s.select("sid", F.size("toks").alias("m")), "sid")
    chunks = rows.groupBy("tok").agg(F.ceil(F.sum("m") / chunk).alias("k"))
    rows = rows.join(chunks, "tok").withColumn("chunk", F.pmod(F.xxhash64("sid"), "k"))
    met = rows.select("tok", "sid", "comp", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("with"))
    met = met.withColumns({"left": F.least("chunk", "with"), "right": F.greatest("chunk", "with")})
    met = met.join(s, "sid").select("tok", "left", "right", "sid", "comp", "n", "chunk", "toks")
    met = met.repartition(partitions(sets.sparkSession), "tok", "left", "right").sortWithinPartitions("tok", "left", "right")
    return met.mapInPandas(_list_links, "a long, b long")


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of sets that link."""
    s = sets.select("sid", "n", "toks")
    rows = pairs.join(s.withColumnsRenamed({"sid": "b", "n": "nb", "toks": "tb"}), "b")
    rows = rows.join(s.withColumnsRenamed({"sid": "a", "n": "na", "toks": "ta"}), "a")
    return rows.sortWithinPartitions("a").select("a", "na", "ta", "b", "nb", "tb").mapInPandas(_overlaps, "a long, b long")


def components(labels: DataFrame, new: DataFrame) -> DataFrame:
    """The labels (sid, comp), comp the smallest sid reached so far, after the links (a, b) of `new` join groups.

    Only the groups that new links touch are walked: minimum labels and pointer jumping over the groups.
    """
    ends = new.join(labels.select(F.col("sid").alias("a"), F.col("comp").alias("ca")), "a")
    ends = ends.join(labels.select(F.col("sid").alias("b"), F.col("comp").alias("cb")), "b").filter("ca <> cb")
    both = keep(ends.select(F.inline(F.array(F.struct("ca", "cb"), F.struct(F.col("cb").alias("ca"), F.col("ca").alias("cb"))))).distinct(), "edges")
    if both.isEmpty():
        return labels
    tops = keep(both.groupBy("ca").agg(F.min("cb").alias("near")).select("ca", F.least("ca", "near").alias("top")), "tops")
    while True:
        near = both.join(tops.select(F.col("ca").alias("cb"), "top"), "cb").groupBy("ca").agg(F.min("top").alias("near"))
        step = tops.join(near, "ca").select("ca", "top", F.least("top", "near").alias("to"))
        jump = tops.select(F.col("ca").alias("to"), F.col("top").alias("far"))
        tops = keep(step.join(jump, "to").select("ca", F.least("to", "far").alias("top"), F.col("top").alias("was")), "tops")
        if tops.filter("top <> was").isEmpty():
            break
    moved = tops.select(F.col("ca").alias("comp"), "top")
    return keep(labels.join(moved, "comp", "left").select("sid", F.coalesce("top", "comp").alias("comp")), "labels")


def _fits(na, nb):
    return (na * 100 >= nb * PERCENT) & (nb * 100 >= na * PERCENT)


def grouped_sets(sets: DataFrame) -> DataFrame:
    """(sid, comp) of the sets."""
    with scope(sets.sparkSession) as kept:
        return _grouped_sets(sets, kept)


def _grouped_sets(sets: DataFrame, kept: scope) -> DataFrame:
    spark = sets.sparkSession
    post = sets.select("sid", "n", "own", F.posexplode(F.slice("toks", F.lit(1), F.col("first"))).alias("pos", "tok"))
    post = postings = keep(post.withColumn("pos", F.col("pos") + F.col("own")).drop("own"), "postings")
    # Lists with the same sets stand for each other; the first in the global order bounds overlaps best.
    lists = post.groupBy("tok").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"),
        F.min("sid").alias("lo"), F.min_by("pos", "sid").alias("at")).filter("m > 1")
    lists = lists.groupBy("m", "x", "y", "lo").agg(F.min_by("tok", "at").alias("tok"))
    post = keep(post.join(lists.select("tok"), "tok", "left_semi"), "lists")
    kept.free(postings)
    tried = spark.createDataFrame([], "a long, b long")
    labels = sets.select("sid", F.col("sid").alias("comp"))
    one = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    need = lambda na, nb: F.ceil((na + nb) * PERCENT / (100.0 + PERCENT) - 1e-9)
    last = NARROW + WIDE
    for r in range(last + 1):
        with scope(spark) as part:
            at = keep(post.join(labels, "sid"), "labelled")
            open_ = at.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.min_by(
                F.struct("sid", "comp", "n", "pos"), F.xxhash64("sid", F.lit(min(r, last - 1)))).alias("rep")).filter("lo < hi")
            open_ = keep(open_, "open")
            if open_.isEmpty():
                break
            if r == last:
                # The set that the round before compared with all others of its list is done.
                left = keep(at.join(open_.select("tok", F.col("rep.sid").alias("done")), "tok").filter("sid <> done").drop("done"), "left")
                several = left.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
                with scope(spark, batch=200):
                    new = part.result(list_links(left.join(several, "tok", "left_semi"), sets), "links")
                return kept.result(components(labels, new), "labels")
            pairs = at.join(open_, "tok").filter((F.col("comp") != F.col("rep.comp")) & _fits(F.col("n"), F.col("rep.n")))
            # The first shingle that two sets share leaves room for the whole overlap.
            pairs = pairs.filter(F.least(F.col("n") - F.col("pos"), F.col("rep.n") - F.col("rep.pos")) >= need(F.col("n"), F.col("rep.n")))
            if r < NARROW:
                pairs = pairs.groupBy("sid").agg(F.max_by("rep", F.struct("m", "tok")).alias("rep"))
            pairs = pairs.select(F.col("rep.sid").alias("a"), F.col("sid").alias("b"))
            pairs = part.result(one(pairs).join(tried, ["a", "b"], "left_anti"), "pairs")
            if pairs.isEmpty():
                continue
            labels = part.result(components(labels, keep(links(pairs, sets), "links")), "labels")
            tried = tried.union(pairs)
    return kept.result(labels, "labels")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n, grp) for each row of (doc_id, text); grp is null for an empty set."""
    with scope(docs.sparkSession, batch=1000, conf=BLOOM) as kept:
        profile = keep(docs.mapInPandas(_profile, "doc_id long, set_id string, n long"), "profile")
        known = docs.filter(F.col("doc_id").isNotNull())
        likely = keep(likely_sets(known), "likely")
        reps = profile.filter(F.col("doc_id").isNotNull()).join(likely, "set_id").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
        reps = keep(reps.withColumn("sid", F.monotonically_increasing_id()), "reps")
        kept.free(likely)
        sets = ordered_sets(known, reps)
        groups = reps.join(grouped_sets(sets), "sid").select("set_id", "comp")
        kept.free(sets)
        # A set outside all groups is its own; the documents of an empty set stay apart.
        group = F.when(F.col("n") == 0, F.lit(None)).otherwise(F.coalesce(F.col("comp").cast("string"), F.col("set_id")))
        return kept.result(profile.join(groups, "set_id", "left").select("doc_id", "n", group.alias("grp")), "grouped")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each document row."""
    rows = grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    least = rows.groupBy("grp").agg(F.min("doc_id").alias("least"))
    least = least.filter(F.col("grp").isNotNull())
    out = rows.join(least, "grp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The documents, one row of each group: the one with the smallest doc_id, rows with a null doc_id last.

    Rows are told apart by doc_id and text. Those that agree in both are one document, except that rows
    with a null doc_id and a blank text all stay.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), "text", row_key("text").alias("key"))
    with scope(docs.sparkSession) as kept:
        found = grouped(rows.select(F.col("key").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
        found = found.filter(F.col("grp").isNotNull()).select(F.col("doc_id").alias("key"), "grp").distinct()
        found = keep(found.join(rows.select("key", "id").distinct(), "key"), "members")
        stay = found.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"))
        gone = kept.result(found.join(stay, "grp").filter(F.col("key") != F.col("first.key")).select("key"), "gone")
    again = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    rest = rows.join(gone, "key", "left_anti")
    if again.isEmpty():
        return rest.select("doc.*")
    apart = F.col("id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    return rest.filter(apart).unionByName(rest.filter(~apart).dropDuplicates(["key"])).select("doc.*")
