"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean trigram query (an OR of AND clauses).
The index holds a posting (trigram, doc_id) for each trigram that some rule's query names; the
postings of a clause are intersected by counting how many of its trigrams a document has. Only
documents that satisfy a clause are verified with the expression. A rule without mandatory
trigrams (hex digits) is verified on every document.

Defined results: null text counts as empty; a repeated doc_id is verified row by row (its index
entry is the union of its rows); a null doc_id is a key like any other; other columns are ignored.
"""

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Most strings that a part of an expression is expanded to.
EXPAND = 64


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters are secrets of this kind."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Maximal runs of 16 and more: the runs `[0-9a-f]+` finds, without listing the short ones.
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("live", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


# Trigram queries

def _strings(op, arg) -> set[str] | None:
    """All strings that one item can match, folded to lower case, or None if they are too many."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        if any(o is not C.LITERAL for o, _ in arg) or len(arg) > 8:
            return None
        return {chr(a).lower() for _, a in arg}
    if op is C.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.MAX_REPEAT and arg[1] <= 4:
        inner, out = _sequence(arg[2]), set()
        for n in range(arg[0], arg[1] + 1):
            once = {""}
            for _ in range(n):
                if inner is None or len(once) * len(inner) > EXPAND:
                    return None
                once = {a + b for a in once for b in inner}
            out |= once
        return out
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > EXPAND:
            return None
        out = {a + b for a in out for b in more}
    return out


def _clauses(items) -> list[frozenset[str]]:
    """An OR of ANDs of trigrams that every match satisfies; an empty clause asks for nothing."""
    found, run = [frozenset()], {""}

    def flush():
        nonlocal found, run
        if all(len(s) >= 3 for s in run):
            both = {c | {s[i:i + 3] for i in range(len(s) - 2)} for c in found for s in run}
            if len(both) <= EXPAND:
                found = list(both)
        run = {""}

    for op, arg in items:
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= EXPAND:
            run = {a + b for a in run for b in more}
            continue
        flush()
        if more is not None:
            run = more
        elif op is C.SUBPATTERN:
            found = [a | b for a in found for b in _clauses(arg[3])]
        elif op is C.BRANCH:
            found = [a | b for a in found for p in arg[1] for b in _clauses(p)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
            found = [a | b for a in found for b in _clauses(arg[2])]
    flush()
    return [frozenset()] if frozenset() in found else sorted(set(found), key=sorted)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The clauses of a pattern, or None if it has no mandatory trigram."""
    clauses = _clauses(_parser.parse(pattern))
    return None if frozenset() in clauses else clauses


# Index

def trigram_index(docs: DataFrame, rules=RULES) -> DataFrame:
    """Postings (gram, doc_id) of the trigrams that the rules' queries name."""
    grams = sorted({g for r in rules for c in trigram_query(r.pattern) or () for g in c})
    folded = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("folded"))
    held = folded.select("doc_id", *[F.contains("folded", F.lit(g)).alias(f"g{i}") for i, g in enumerate(grams)])
    posted = F.array(*[F.when(F.col(f"g{i}"), F.lit(g)) for i, g in enumerate(grams)])
    return held.select("doc_id", F.explode(F.array_compact(posted)).alias("gram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, kinds): the rules with a clause all of whose trigrams the document has."""
    terms = [(r.kind, i, g, len(c)) for r in rules for i, c in enumerate(trigram_query(r.pattern) or ()) for g in c]
    # As many rows as the rules have trigrams, whatever the corpus.
    wanted = F.broadcast(index.sparkSession.createDataFrame(terms, "kind string, clause int, gram string, need int"))
    hit = index.join(wanted, "gram").groupBy("doc_id", "kind", "clause", "need").agg(F.count_distinct("gram").alias("n"))
    return hit.filter("n = need").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


# Verification

def _spans(kind: str, order: int, least: int, matches: str, groups: str, pieces: str) -> Column:
    """[(start, order, kind, end)] from the matches and the pieces between them, in code points."""
    step = F.zip_with(
        F.slice(F.col(pieces), F.lit(1), F.size(matches)), F.zip_with(matches, groups, lambda m, g: F.struct(
            F.char_length(m).alias("m"), F.char_length(g).alias("g"))),
        lambda p, x: F.struct(F.char_length(p).alias("p"), x["m"].alias("m"), x["g"].alias("g")))
    one = lambda start, end: F.struct(
        start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end"))
    none = F.array_remove(F.array(one(F.lit(0), F.lit(0))), one(F.lit(0), F.lit(0)))
    return F.aggregate(
        step, F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["p"] + x["m"]).alias("at"),
            F.when(x["g"] >= least, F.concat(acc["found"], F.array(one(acc["at"] + x["p"], acc["at"] + x["p"] + x["m"]))))
            .otherwise(acc["found"]).alias("found")),
        lambda acc: acc["found"])


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Every document row with `found`: its secrets as (start, order, kind, end), ordered."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = candidates(keep(trigram_index(docs, rules), "trigrams"), rules).withColumnRenamed("doc_id", "key")
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("key")), "left").drop("key")
    columns = []
    for i, r in enumerate(rules):
        text = F.col("text")
        if trigram_query(r.pattern) is not None:
            text = F.when(F.array_contains("kinds", F.lit(r.kind)), text)
        none = F.array().cast("array<string>")
        columns += [F.coalesce(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)), none).alias(f"m{i}"),
                    F.coalesce(F.split(text, r.pattern, -1), none).alias(f"p{i}")]
        if r.group:
            columns.append(F.coalesce(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)), none).alias(f"g{i}"))
    parts = rows.select("doc_id", *columns)
    spans = [_spans(r.kind, i, r.least, f"m{i}", f"g{i}" if r.group else f"m{i}", f"p{i}") for i, r in enumerate(rules)]
    return parts.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def joined(found) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame, base=BASE) -> DataFrame:
    """Counts and digests of scanned rows."""
    def of(i):
        return F.filter("found", lambda x: x["order"] == i)

    first = F.filter("found", lambda x: x["order"] < len(base))
    counts = [F.size(of(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(base)]
    return found.select("doc_id", *counts, F.sha2(joined(first), 256).alias("base_sha256"), joined("found").alias("spans"))


# SQL

def sql(rules=RULES, base=BASE) -> str:
    """The same rows by DuckDB, scanning every text for every rule."""
    lists, n = [], len(base)
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        lists.append(
            f"list_filter(list_transform(range(len(regexp_extract_all(t, '{p}', 0))), lambda i: {{"
            f"'s': list_sum(list_transform(string_split_regex(t, '{p}')[1:i + 1], lambda x: length(x)))"
            f" + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}', 0)[1:i], lambda x: length(x))), 0),"
            f" 'o': {i}, 'k': '{r.kind}', 'm': length(regexp_extract_all(t, '{p}', 0)[i + 1]),"
            f" 'g': length(regexp_extract_all(t, '{p}', {r.group})[i + 1])}}), lambda x: x.g >= {r.least})")
    all_spans = "list_sort(" + " || ".join(lists) + ")"
    text = "list_transform({}, lambda x: x.k || ':' || x.s::BIGINT || ':' || (x.s + x.m)::BIGINT)"
    counts = ", ".join(f"len(list_filter(f, lambda x: x.o = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(base))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS (SELECT doc_id, {all_spans} AS f FROM d)
        SELECT doc_id, {counts},
            sha256(coalesce(array_to_string({text.format(f"list_filter(f, lambda x: x.o < {n})")}, ','), '')) AS base_sha256,
            coalesce(array_to_string({text.format('f')}, ','), '') AS spans
        FROM s"""


def brute(text: str | None, rules=RULES) -> list[tuple[int, int, str, int]]:
    """One text by Python's engine, for tests."""
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.A):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), i, r.kind, m.end()))
    return sorted(out)
