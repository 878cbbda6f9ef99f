"""Removal of repeated byte strings over a sparse, range-partitioned suffix array.

Every string of LENGTH bytes is assigned to one anchor in it: the 48 leading bytes with the smallest
hash, the leftmost at a tie. Equal strings have their anchor at the same place, so they can only meet
at suffixes whose leading tokens (the anchor's bytes) are equal.

1. Each document's anchors are listed with the range of strings they stand for (a context). Anchors
   whose leading tokens are alone in the corpus are out; contexts that are equal as a whole repeat as
   a whole, and one of each is enough for the rest.
2. The suffixes at the anchors that stay are range-partitioned by their leading tokens with sampled
   splitters (Spark's range exchange). Splitters lie between different leading tokens, so no match
   crosses a bucket's boundary.
3. A bucket sorts its suffixes, and the reversed texts before them, by multikey quicksort on 8-byte
   keys, and compares neighbours. The string that starts d bytes before an anchor is repeated if
   another suffix agrees on LENGTH - d bytes after and d bytes before, that is, falls in the same runs of
   both orders.
4. Leading tokens of more than HOT different contexts would overfill a bucket: the strings of those
   are compared across buckets by a 128-bit hash, counted with map-side combining.

The same is done with words for bytes, a word standing as a 64-bit hash, to show passages of more than 50
words that another row has too (strings of PASSAGE words): they can be shorter than LENGTH bytes, and stay.

Defined results: null text is empty; repeated rows are repeats of each other; a null doc_id is a
document like any other; texts shorter than LENGTH keep all bytes.
"""

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered_join, keep, mix64, partitions, pieces_of, semi

LENGTH = 400
LEAD = 48
#: Contexts of a bucket, about, and of one leading string, at most.
BUCKET = 10_000
HOT = 50_000
PASSAGE = 51


class Unit(NamedTuple):
    """What strings consist of: units of a string and of its leading part, bytes of a unit. Words count if two rows have them."""

    length: int
    lead: int
    width: int


BYTES = Unit(LENGTH, LEAD, 1)
WORDS = Unit(PASSAGE, 8, 8)

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


class Rolling:
    """Hashes of any substring of a byte string in constant time."""

    def __init__(self, x: np.ndarray):
        up, self.down = _power(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:len(x)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(x: np.ndarray, length: int = LENGTH, lead: int = LEAD):
    """(anchor, first start, last start, hash of the leading bytes, hash of the context), one for each anchor."""
    none = np.zeros(0, np.int64)
    if len(x) < length:
        return none, none, none, none, none
    roll = Rolling(x)
    at = np.arange(len(x) - lead + 1)
    h = roll.of(at, at + lead)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    w = length - lead + 1
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(key)] = key
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - length + 1
    best = (np.minimum(after[:n], before[w - 1:w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], best[1:] != best[:-1]]))[0]
    last = np.append(first[1:], n) - 1
    a = best[first]
    shape = mix64((a - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64))
    return a, first, last, h[a].view(np.int64), mix64(roll.of(first, last + length) ^ shape).view(np.int64)


def word_places(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word (what ASCII white space separates) and the byte after it."""
    x = np.frombuffer(b, np.uint8)
    edge = np.diff(np.concatenate([[True], (x == 32) | ((x >= 9) & (x <= 13)), [True]]).view(np.int8))
    return np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]


def _units(text: str, unit: Unit) -> np.ndarray:
    x = np.frombuffer(text.encode(), np.uint8)
    return x if unit.width == 1 else Rolling(x).of(*word_places(x.tobytes()))


def _anchors(unit: Unit):
    def run(batches):
        for pdf in pieces_of(batches, lambda r: len(r.text or ""), 4 << 20):
            out = [anchors(_units(t or "", unit), unit.length, unit.lead) for t in pdf["text"]]
            sizes = [len(o[0]) for o in out]
            a, lo, hi, kh, ch = (np.concatenate([o[i] for o in out]) for i in range(5))
            yield pd.DataFrame({c: np.repeat(pdf[c].to_numpy(), sizes) for c in pdf.columns if c != "text"} | {"a": a, "lo": lo, "hi": hi, "kh": kh, "ch": ch})

    return run


_ANCHOR = "a int, lo int, hi int, kh long, ch long"
_CONTEXT = "kh long, ch long, ctx binary, off int, lead binary"
_OWNERS = ", first long, last long"


def _contexts(unit: Unit):
    def run(batches):
        n, lead, w = unit
        for pdf in batches:
            out = []
            for text, wanted in zip(pdf["text"], pdf["wanted"], strict=True):
                b = _units(text, unit).astype(f">u{w}").tobytes()
                out += [(x["kh"], x["ch"], b[x["lo"] * w:(x["hi"] + n) * w], x["a"] - x["lo"], b[x["a"] * w:(x["a"] + lead) * w],
                         *([x["first"], x["last"]] if "first" in x else [])) for x in wanted]
            names = ["kh", "ch", "ctx", "off", "lead", "first", "last"]
            yield pd.DataFrame(out, columns=names if unit.width > 1 else names[:5])

    return run


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of 8-byte keys: every run of ties is partitioned by its next key, all runs of a depth at once."""
    n = len(words)
    order, run = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)
    for c in range(words.shape[1]):
        if len(tied) < 2:
            break
        key = words[order[tied], c]
        sub = np.lexsort((key, run[tied]))
        order[tied], key, r = order[tied][sub], key[sub], run[tied]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (r[1:] != r[:-1])
        run[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        alone = fresh & np.append(fresh[1:], True)
        tied = tied[~alone]
    return order


def _ranked(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of each string in the order, and the common prefix of each with the one before it in that order."""
    width = -(-width // 8) * 8
    raw = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    order = multikey_order(np.ascontiguousarray(raw).view(">u8").astype(np.uint64))
    lcp = np.zeros(len(strings), np.int64)
    for s in range(1, len(strings), 4096):
        e = min(len(strings), s + 4096)
        differ = raw[order[s:e]] != raw[order[s - 1:e - 1]]
        lcp[s:e] = np.where(differ.any(1), differ.argmax(1), width)
    place = np.empty(len(strings), np.int64)
    place[order] = np.arange(len(strings))
    return place, lcp


def repeated(contexts: list[tuple[bytes, int]], unit: Unit = BYTES, owners=None) -> np.ndarray:
    """For contexts (bytes, place of the anchor): the matrix [context, d] of strings that another context has too.

    owners: the least and the largest owner of each context; then, of strings that more than one owner has.
    """
    n, (length, _, w) = len(contexts), unit
    most = np.array([off for _, off in contexts])
    least = np.array([length - (len(c) // w - off) for c, off in contexts])
    first, last = (np.arange(n), np.arange(n)) if owners is None else owners
    marks = np.zeros((n, int(most.max()) + 1), bool)
    after, after_lcp = _ranked([c[off * w:] for c, off in contexts], length * w)
    before, before_lcp = _ranked([c[:off * w][::-1] for c, off in contexts], max(8, int(most.max()) * w))
    for d in range(int(least.min()), int(most.max()) + 1):
        on = np.nonzero((least <= d) & (d <= most))[0]
        if len(on) < 2:
            continue
        key = np.cumsum(after_lcp < (length - d) * w)[after[on]] * (n + 1) + np.cumsum(before_lcp < d * w)[before[on]]
        order = np.argsort(key, kind="stable")
        key, on = key[order], on[order]
        start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        several = np.minimum.reduceat(first[on], start) < np.maximum.reduceat(last[on], start)
        marks[on, d] = np.repeat(several, np.diff(np.append(start, len(on))))
    return marks


def _runs(kh, ch, marks: np.ndarray) -> pd.DataFrame:
    rows = np.nonzero(marks.any(1))[0]
    out = []
    for i in rows:
        edge = np.diff(np.concatenate([[0], marks[i].view(np.int8), [0]]))
        out.append((kh[i], ch[i], [{"d1": int(a), "d2": int(b) - 1} for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0], strict=True)]))
    return pd.DataFrame({"kh": pd.Series([o[0] for o in out], dtype="int64"), "ch": pd.Series([o[1] for o in out], dtype="int64"),
                         "runs": pd.Series([o[2] for o in out], dtype=object)})


_RUNS = "kh long, ch long, runs array<struct<d1:int,d2:int>>"


def _bucket(unit: Unit):
    def marked(rows):
        owners = [np.array([r[i] for r in rows]) for i in (5, 6)] if unit.width > 1 else None
        return _runs([r[0] for r in rows], [r[1] for r in rows], repeated([(r[2], r[3]) for r in rows], unit, owners))

    def run(batches):
        """Sorted by leading bytes; whole groups of equal leads are taken until there are enough contexts."""
        rows, lead = [], None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if len(rows) >= BUCKET and r.lead != lead:
                    yield marked(rows)
                    rows = []
                lead = r.lead
                rows.append(r)
        if rows:
            yield marked(rows)

    return run


def _windows(unit: Unit):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = np.frombuffer(r.ctx, f">u{unit.width}").astype(f"u{unit.width}")
                start = np.arange(len(x) - unit.length + 1)
                d = r.off - start
                one = Rolling(x).of(start, start + unit.length)
                two = Rolling(x ^ x.dtype.type(0x5A)).of(start, start + unit.length)
                yield pd.DataFrame({"kh": r.kh, "ch": r.ch, "d": d, "w1": mix64(one ^ d.astype(np.uint64)).view(np.int64), "w2": two.view(np.int64),
                                    "first": r.first, "last": r.last})

    return run


def repeated_runs(contexts: DataFrame, n: int, unit: Unit = BYTES) -> DataFrame:
    """(kh, ch, runs) of contexts of which no leading string has more than HOT."""
    spark = contexts.sparkSession
    buckets = max(partitions(spark), -(-n // BUCKET))
    dealt = contexts.repartitionByRange(buckets, "lead").sortWithinPartitions("lead")
    return dealt.mapInPandas(_bucket(unit), _RUNS)


def repeated_hot(contexts: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """The same for leading strings with more contexts, string by string."""
    if unit.width == 1:
        contexts = contexts.withColumns({"first": F.col("ch"), "last": F.col("ch")})
    each = contexts.mapInPandas(_windows(unit), "kh long, ch long, d int, w1 long, w2 long" + _OWNERS)
    twice = each.groupBy("w1", "w2").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last").select("w1", "w2")
    hit = each.join(twice, ["w1", "w2"], "left_semi").select("kh", "ch", "d")
    return hit.groupBy("kh", "ch").agg(F.transform(F.array_sort(F.collect_list("d")), lambda d: F.struct(d.alias("d1"), d.alias("d2"))).alias("runs"))


def merged(spans) -> list:
    """The maximal runs [start, end] of spans."""
    runs = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(e, runs[-1][1])
        else:
            runs.append([s, e])
    return runs


def remaining(b: bytes, spans: list) -> tuple[str, str, int, int, str]:
    """What is left as text, the maximal runs as start:end, their bytes and number, and the SHA-256 of the bytes left."""
    runs = merged(spans)
    kept = b"".join(b[i:j] for i, j in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(b)], strict=True))
    return (kept.decode(errors="ignore"), ",".join(f"{s}:{e}" for s, e in runs), len(b) - len(kept), len(runs),
            hashlib.sha256(kept).hexdigest())


def shown(b: bytes, passages: list) -> tuple[int, int, str]:
    """Words and number of the maximal runs of words, and the runs as start:end in bytes."""
    runs, (start, end) = merged(passages), word_places(b)
    return sum(e - s for s, e in runs), len(runs), ",".join(f"{start[s]}:{end[e - 1]}" for s, e in runs)


def _remove(text: pd.Series, spans: pd.Series, passages: pd.Series) -> pd.DataFrame:
    out = []
    for t, s, p in zip(text, spans, passages, strict=True):
        b = None if t is None else t.encode()
        out.append((None, "", 0, 0, None, 0, 0, "") if b is None else (*remaining(b, () if s is None else s), *shown(b, () if p is None else p)))
    return pd.DataFrame(out, columns=["text", "spans", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages", "passages"])


_REMAINING = ("text string, spans string, n_removed long, n_spans long, kept_sha256 string, "
              "n_passage_words long, n_passages long, passages string")


def _repeats(docs: DataFrame, unit: Unit) -> DataFrame:
    """(doc, mark, spans): ranges of units, of documents that have any, that strings which occur again cover."""
    name = "" if unit.width == 1 else "word_"
    owner = [] if unit.width == 1 else ["first", "last"]
    # Words are asked for in two rows, so each row has a number; it is read only from the kept anchors.
    who = {"who": F.monotonically_increasing_id()} if owner else {}
    several = F.min("who") < F.max("who") if owner else F.count("*") > 1
    long_enough = docs.filter(F.octet_length("text") >= unit.length).select("doc", "mark", "text").withColumns(who)
    rows = keep(long_enough.mapInPandas(_anchors(unit), "doc long, mark long, " + ("who long, " if owner else "") + _ANCHOR), name + "anchors")
    twice = keep(rows.groupBy("kh").agg(several.alias("several")).filter("several").select("kh"), name + "leads")
    some = keep(semi(rows, twice), name + "candidates")
    each = some.groupBy("kh", "ch").agg(several.alias("several"), F.min(F.struct("doc", "mark", "a", "lo", "hi")).alias("rep"),
                                        *([F.min("who").alias("first"), F.max("who").alias("last")] if owner else []))
    each = keep(each, name + "contexts")
    sizes = each.groupBy("kh").agg(F.count("*").alias("m")).filter("m > 1")
    asked = each.join(sizes, "kh").select("rep.*", "kh", "ch", *owner)
    asked = asked.groupBy("doc", "mark").agg(F.collect_list(F.struct("kh", "ch", "a", "lo", "hi", *owner)).alias("wanted"))  # of one document
    texts = filtered_join(docs.select("doc", "mark", "text"), keep(asked, name + "asked"), ["doc", "mark"])
    found = keep(texts.select("text", "wanted").mapInPandas(_contexts(unit), _CONTEXT + (_OWNERS if owner else "")), name + "suffixes")
    hot = keep(sizes.filter(F.col("m") > HOT).select("kh"), name + "hot")
    if hot.isEmpty():
        runs = repeated_runs(found, found.count(), unit)
    else:
        cool = found.join(hot, "kh", "left_anti")
        runs = repeated_runs(cool, cool.count(), unit).unionByName(repeated_hot(found.join(hot, "kh", "left_semi"), unit))
    known = each.select("kh", "ch", "several").join(runs, ["kh", "ch"], "left").filter(F.col("several") | F.col("runs").isNotNull())
    hits = some.join(keep(known, name + "known"), ["kh", "ch"])
    whole = F.array(F.struct(F.col("lo").alias("s"), (F.col("hi") + unit.length).alias("e")))
    part = F.transform("runs", lambda x: F.struct((F.col("a") - x["d2"]).alias("s"), (F.col("a") - x["d1"] + unit.length).alias("e")))
    spans = hits.select("doc", "mark", F.when(F.col("several"), whole).otherwise(part).alias("spans"))
    return keep(spans.groupBy("doc", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans")), name + "spans")  # of one document


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc, mark, spans): byte ranges to remove, of documents that have any."""
    return _repeats(docs, BYTES)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc, mark, passages): ranges of words, of documents that have any, in strings of PASSAGE words that another row has too."""
    return _repeats(docs, WORDS).withColumnRenamed("spans", "passages")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the input), n_removed, n_spans, kept_sha256, spans, text and passages for each document row.

    spans are the removed runs, start:end in bytes of the input, comma-joined; text is what is left. A run
    may begin or end inside a character: kept_sha256 is of the exact bytes, text leaves out such odd bytes.
    passages are the maximal runs of words, likewise in bytes, that lie in strings of more than 50 words which
    another row has too, whatever white space separates them; n_passage_words counts their words, n_passages
    the runs. Nothing is removed for them: most are in spans too, the others are shorter than LENGTH bytes.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63))
    docs = docs.select("doc_id", text.alias("text"), key.alias("doc"), F.xxhash64(text).alias("mark"))
    both = removed_spans(docs).join(repeated_passages(docs), ["doc", "mark"], "full")
    rows = docs.join(both, ["doc", "mark"], "left")
    # Only texts that repeat something go to Python.
    remove = F.pandas_udf(_remove, _REMAINING)
    rows = rows.withColumn("cut", remove(F.when(F.col("spans").isNotNull() | F.col("passages").isNotNull(), F.col("text")), "spans", "passages"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "cut.n_removed", "cut.n_spans",
                       F.coalesce("cut.kept_sha256", F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"),
                       "cut.spans", F.coalesce("cut.text", "text").alias("text"), "cut.n_passage_words", "cut.n_passages", "cut.passages")
