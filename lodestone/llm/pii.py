"""Personal data by bootstrapped contextual extraction.

Seeds are the spans that fixed patterns find (email, ip, card, phone). The words around a seed
induce lexical patterns: (two words before) and (word before, word after). Other identifier-like
tokens (with a digit or @) in the same contexts are candidate instances. Spark scores the graph of
patterns and instances in rounds: a pattern's confidence in a kind is the summed confidence of its
distinct instances over their number plus a prior; an instance's confidence is the chance that not
all of its patterns are wrong. Candidates that reach ACCEPT are added as spans of kind context_<kind>.

Defined results: null text is empty; each row of a repeated doc_id has its own result (equal texts
of one doc_id share theirs); a null doc_id is kept; other columns are left alone.
"""

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pieces_of, small_batches

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Added to a pattern's instances, so that rare patterns are not trusted; least confidences.
PRIOR = 2.0
TRUST = 0.7
ACCEPT = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]\S*")
_EDGE = ".,;:!?\"'()[]{}<>*#$&%|=~`"
#: Characters before and after a mention in which its context words are looked for.
NEAR = 120


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        # The leftmost start of a match that takes this @ is the start of the run of local characters.
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(last, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def _context(text: str, start: int, end: int) -> list[str]:
    before = [w.strip(_EDGE).lower() for w in text[max(0, start - NEAR):start].split()[-2:]]
    after = [w.strip(_EDGE).lower() for w in text[end:end + NEAR].split()[:1]]
    before, after = ["^"] * (2 - len(before)) + before, after or ["$"]
    return [f"{before[0]} {before[1]} _", f"{before[1]} _ {after[0]}"]


def mentions(text: str, spans) -> list[tuple[int, int, int, str, list[str]]]:
    """(kind or -1, start, end, instance, contexts) of seeds and of other identifier-like tokens."""
    out = [(k, s, e, text[s:e].lower(), _context(text, s, e)) for k, s, e in spans]
    taken = sorted((s, e) for _, s, e in spans)
    i = 0
    for m in _SIGN.finditer(text):
        start, end = m.span()
        while start and not text[start - 1].isspace():
            start -= 1
        start += len(text[start:end]) - len(text[start:end].lstrip(_EDGE))
        end -= len(text[start:end]) - len(text[start:end].rstrip(_EDGE))
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if end - start >= 5 and (i == len(taken) or taken[i][0] >= end):
            out.append((-1, start, end, text[start:end].lower(), _context(text, start, end)))
    return out


_FOUND = ("doc_id long, mark long, row long, base array<struct<kind:int,start:int,end:int>>, "
          "mentions array<struct<kind:int,start:int,end:int,instance:string,contexts:array<string>>>")


def _extract(batches):
    for pdf in pieces_of(batches, lambda r: len(r.text or ""), 4 << 20):
        base, seen = [], []
        for t in pdf["text"]:
            spans = base_spans(t or "")
            base.append(spans)
            seen.append(mentions(t or "", spans))
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "mark": pdf["mark"], "row": pdf["row"], "base": base, "mentions": seen})


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, row, base, mentions), without texts; mark tells texts of one doc_id apart."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark(), F.monotonically_increasing_id().alias("row"))
    return keep(rows.mapInPandas(_extract, _FOUND), "mentions")


def mark():
    return F.xxhash64("text").alias("mark")


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) of accepted candidates."""
    flat = found.select(F.explode("mentions").alias("m")).select("m.*")
    edges = keep(flat.select("kind", "instance", F.explode("contexts").alias("context")).distinct(), "edges")
    seeds = edges.filter("kind >= 0").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    links = edges.select("instance", "context").distinct()
    new = edges.filter("kind < 0").select("instance", "context").distinct()
    sizes = links.groupBy("context").agg(F.count("*").alias("n"))
    scores = seeds = keep(seeds, "seeds")
    for _ in range(rounds):
        mass = links.join(scores, "instance").groupBy("context", "kind").agg(F.sum("score").alias("mass"))
        trust = mass.filter(F.col("mass") >= PRIOR * TRUST).join(sizes, "context")
        trust = trust.select("context", "kind", (F.col("mass") / (F.col("n") + PRIOR)).alias("trust")).filter(F.col("trust") >= TRUST)
        one = new.join(trust, "context").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        one = one.join(seeds.select("instance").distinct(), "instance", "left_anti")
        scores = keep(seeds.unionByName(one), "scores")
    best = scores.join(seeds.select("instance").distinct(), "instance", "left_anti").filter(F.col("score") >= ACCEPT)
    return best.groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, mark, row, base, more): fixed spans and those that bootstrapping adds."""
    seen = found.select("row", F.explode("mentions").alias("m")).filter("m.kind < 0")
    seen = seen.select("row", "m.start", "m.end", "m.instance")
    more = seen.join(bootstrap(found), "instance").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.select("doc_id", "mark", "row", "base").join(more, "row", "left").withColumn("more", F.coalesce("more", none))


def _joined(prefix, column):
    names = F.array(*[F.lit(prefix + k) for k in KINDS])
    return F.transform(column, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"]))


def digest(found: DataFrame) -> DataFrame:
    def count(i):
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    base = _joined("", "base")
    return found.select(
        "doc_id", *[count(i) for i in range(len(KINDS))], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _joined("context_", "more")), ",").alias("spans"))


def masked(text: str, base, more) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, last = [], 0
    for start, end, kind in sorted((x["start"], -x["end"], x["kind"]) for x in [*base, *more]):
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
            last = -end
        else:
            last = max(last, -end)
    return "".join(out) + text[last:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with masked texts, their lengths set anew."""
    found = spans(extract(docs)).filter((F.size("base") > 0) | (F.size("more") > 0))
    found = found.select(F.col("doc_id").alias("key"), F.col("mark").alias("key_mark"), "base", "more").dropDuplicates(["key", "key_mark"])
    # The document is one struct, so that its columns cannot clash with the keys.
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), mark())
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("key")) & F.col("mark").eqNullSafe(F.col("key_mark")), "left")

    @F.pandas_udf("string")
    def mask(text: pd.Series, base: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([t if b is None else masked(t, b, m) for t, b, m in zip(text, base, more, strict=True)], dtype=object)

    doc = F.col("doc")
    new = rows.select("doc", F.when(F.col("base").isNotNull(), mask(doc["text"], "base", "more")).alias("new"))
    columns = {c: doc[c] for c in docs.columns}
    columns["text"] = F.coalesce("new", doc["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast("long")).otherwise(doc["n_chars"])
    return new.select(*[v.alias(k) for k, v in columns.items()])


def sha(spans_) -> str:
    """The digest of a list of base spans, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans_).encode()).hexdigest()
