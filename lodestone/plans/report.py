"""Answers as bounded text. Every report states its true totals and what it left out.

Long lists are formatted by Spark, measured there, and only the chunks that fit the budget
come to the driver.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import scoring as S
from ..operators import budget, counts, impact, instances, lookup, modules, orphans
from ..runtime import cut
from .index import Index

# Limits of a listing.
SITES_SHOWN = 4
ADDRESSES_SHOWN = 8
MIN_PER_DECLARATION = 400

# Wording of the answers.
EXPLORE_MISS = """No configuration scored above the relevance threshold for {query}.
{nodes} nodes were considered across {roots} root modules.

This is a real miss, not an empty index. Either the subject is not in this repository's
Terraform, or the question uses vocabulary the configuration does not. Try naming a
resource type (aws_s3_bucket), an address (module.vpc), a variable (var.environment), or
a module source — or fall back to grep."""
EXPLORE_HEAD = "Top {shown} of {considered} nodes, best first (relevance {best:.2f} … {worst:.2f}).\n"
EXPLORE_DROPPED = ("{n} more node(s) cleared the relevance threshold but did not fit the "
                   "character budget — ask again with a larger charBudget to see them.\n")
EXPLORE_MORE = "{n} more node(s) cleared the threshold; raise maxNodes to see them.\n"
TRUNCATED = ("[truncated at {shown} of {full} characters — the full block is {file} lines {line}-{end}; "
             "ask again with a larger charBudget]\n")
OMITTED = "\n[{n} {unit} omitted for space — ask again with a larger charBudget]\n"
REFS_MISS = """Nothing in this repository declares {query}.
{nodes} nodes were considered.

The address may belong to a remote module whose internals are not indexed, or it may not
exist. Try the bare local name, or the resource type."""
REFS_HEAD = ("{n} declaration(s) of {query}.\nOnly resolved expression references are listed. A mention in a comment or "
             "inside a quoted string is not a reference and is deliberately absent.\n")
IMPACT_MISS = "Nothing in this repository declares {query}, so it has no impact set."
IMPACT_NONE = ("\nNothing reaches it. For a variable or output this usually means it is dead "
               "configuration; check terra_orphans.\n")
IMPACT_PLAN = "\nResolved against a plan: {n} real instance(s) across this set.\n"
IMPACT_DESTROYED = "\nDESTROYED AND RECREATED by this plan ({n}):\n"
IMPACT_IN_PLACE = "Nothing in this set is replaced by the current plan; changes are in-place updates.\n"
IMPACT_STALE = "\nThe plan is a snapshot. Re-plan after editing configuration or this answer goes stale.\n"
IMPACT_STATE = ("\nResolved against state: {n} real instance(s) across this set.\n"
                "State knows what exists, not what a change would do. For replace-vs-update, supply a\n"
                "plan file rather than a state file.\n")
IMPACT_STATIC = ("\nThis is what is *connected*, not what a plan would replace. Static configuration knows\n"
                 "which expressions read which addresses; only `terraform plan` knows which changes force\n"
                 "replacement. Supply one with --plan to resolve this.\n")
IMPACT_EXPANDING = ("\nLower bound: {n} block(s) in this set use count or for_each, so the real\n"
                    "instance count is higher than the node count: {names}\n")
IMPACT_TRUNCATED = "\nTruncated at depth {depth} — there is more beyond it. Ask again with a larger depth.\n"
NO_MODULES = "This repository contains no module calls."
MODULES_MISS = "No module source or call name matches {query}."
MODULES_HEAD = "{n} module source(s); {skewed} pinned at more than one version.\n"
LOCAL_NOTE = "  (local path — no version to skew)"
SKEW_NOTE = "  ← VERSION SKEW"
NO_ORPHANS = ("No unreferenced variables, locals or child-module outputs. "
              "Root module outputs are excluded by design — they are the stack's public surface.")
ORPHANS_HEAD = ("{n} unreferenced declaration(s).\nA caller passing a value does not count as using it: a variable every "
                "stack wires\nup and nothing inside ever reads is dead configuration with live call sites.\n")
UNRESOLVED = ("\nunresolved references: {n} of {edges} — these point into remote modules or a\n"
              "scope this repository does not contain. Impact sets are incomplete by that much.\n")
NO_OVERLAY = ("\nplan overlay: not loaded — {reason}.\n"
              "Static HCL only: count/for_each expansion and replace-vs-update are not\n"
              "available. Produce one with:\n"
              "  terraform plan -out=tf.plan && terraform show -json tf.plan > tfplan.json\n"
              "left in the root module directory, or pass --plan <root>=<path>.\n")
UNCOVERED = "  no overlay for {n} root(s): {names}\n  answers about those stacks are static-only.\n"


def _quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _dot(path: str) -> str:
    return path or "."


def _padded(column: Column, width: int) -> Column:
    return F.when(F.length(column) < width, F.rpad(column, width, " ")).otherwise(column)


def _omitted(n: int, unit: str) -> str:
    return OMITTED.format(n=n, unit=unit) if n else ""


def _identity() -> Column:
    """The heading of one node."""
    scope = F.when(F.col("module_dir") == "", ".").otherwise(F.col("module_dir"))
    owner = F.when(F.col("shared"), "   stack: (shared by several roots)").when(
        (F.col("stack") != "") & (F.col("stack") != F.col("module_dir")), F.concat(F.lit("   stack: "), "stack"))
    flags = F.array_compact(F.array(
        F.when(F.col("has_count"), "count"), F.when(F.col("has_for_each"), "for_each"),
        F.when(F.col("deprecated"), "moved away — no longer the live address"),
        F.when(F.col("sensitive"), "sensitive"),
    ))
    source = F.concat(F.lit("source: "), "source", F.when(
        F.col("version") != "", F.concat(F.lit("  version: "), "version")).otherwise(""), F.lit("\n"))
    return F.concat_ws(
        "", F.lit("### "), "address", F.lit("\nkind: "), _padded(F.col("kind"), 14), F.lit(" at: "),
        A.location(F.col("file"), F.col("line")), F.lit("\nmodule: "), scope, owner, F.lit("\n"),
        F.when(F.size(flags) > 0, F.concat(F.lit("flags: "), F.array_join(flags, ", "), F.lit("\n"))),
        F.when(F.col("source") != "", source),
        F.when(F.col("doc") != "", F.concat(F.lit("comment: "), "doc", F.lit("\n"))),
    )


def _instance_lines(ix: Index, nodes: DataFrame) -> dict[str, str]:
    """Text on the instances of some few nodes, by node key."""
    found = ix.instances_of(nodes)
    if found is None:
        return {}
    found = found.persist()
    try:
        w = W.partitionBy("node_key", "stack").orderBy("address", "inst_seq")
        listed = found.filter("address != ''").withColumn("rank", F.row_number().over(w))
        listed = listed.filter(F.col("rank") <= ADDRESSES_SHOWN).groupBy("node_key", "stack").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "address"))), lambda r: r["address"]).alias("shown"))
        named = found.groupBy("node_key", "stack").agg(F.count_if(F.col("address") != "").alias("n_named"))
        rows = instances.by_stack(found).join(listed, ["node_key", "stack"], "left").join(
            named, ["node_key", "stack"]).orderBy("node_key", "stack").collect()
    finally:
        found.unpersist()
    texts: dict[str, str] = {}
    for row in rows:
        text = f"instances in {_dot(row['stack'])}: {row['n_instances']}"
        text += f"   planned: {', '.join(row['planned'])}\n" if row["planned"] else "\n"
        if row["shown"]:
            more = row["n_named"] - len(row["shown"])
            text += "  " + "\n  ".join(row["shown"]) + (f"\n  … {more} more" if more else "") + "\n"
        texts[row["node_key"]] = texts.get(row["node_key"], "") + text
    return texts


def explore_text(ix: Index, query: str, max_nodes: int = 5, char_budget: int = S.DEFAULT_CHAR_BUDGET) -> str:
    result = ix.explore(query, max_nodes, char_budget)
    hits = result.hits.withColumn("identity", _identity()).collect() if query.strip() else []
    if not hits:
        return EXPLORE_MISS.format(query=_quote(query), nodes=ix.totals["n_nodes"], roots=ix.graph.roots.count())
    left_out = result.counters.first()
    text = EXPLORE_HEAD.format(shown=len(hits), considered=left_out["considered"],
                               best=hits[0]["score"], worst=hits[-1]["score"])
    if left_out["dropped_for_budget"]:
        text += EXPLORE_DROPPED.format(n=left_out["dropped_for_budget"])
    elif left_out["above_threshold"] > len(hits):
        text += EXPLORE_MORE.format(n=left_out["above_threshold"] - len(hits))
    wanted = ix.spark.createDataFrame([(h["node_key"],) for h in hits], "node_key string")
    instance_text = _instance_lines(ix, wanted)
    for h in hits:
        e = h["excerpt"]
        text += "\n" + h["identity"] + f"referenced by: {h['ref_by_count']}   references: {h['ref_count']}\n"
        text += instance_text.get(h["node_key"], "")
        if e["text"]:
            text += e["text"] if e["text"].endswith("\n") else e["text"] + "\n"
            if e["truncated"]:
                text += TRUNCATED.format(shown=e["shown_len"], full=e["full_len"],
                                         file=h["file"], line=h["line"], end=h["end_line"])
    return text


def _reference_lists(refs: DataFrame, allowance: int) -> DataFrame:
    """(decl_key, referenced_by, references): the listing text per direction, NULL when empty."""
    incoming = F.col("direction") == "referenced_by"
    peer = F.coalesce(
        F.col("peer_address"),
        F.when(F.col("unresolved") != "", F.concat("unresolved", F.lit(" (not in this repository)"))),
        F.lit("(unresolved)"),
    )
    line = F.concat_ws(
        "", F.lit("  "), _padded(peer, 40), F.lit(" "), A.location(F.col("file"), F.col("line")),
        F.when(F.col("kind") != "REFERENCES", F.concat(F.lit("  ["), "kind", F.lit("]"))),
        F.when(incoming & (F.col("traversal") != ""), F.concat(F.lit("  as "), "traversal")), F.lit("\n"),
    )
    group = ["decl_key", "direction"]
    lines = refs.withColumn("text", line).withColumn("cost", F.octet_length("text"))
    listed = budget.listed_within(
        lines.select(*group, *lookup.reference_order(), "text", "cost"), group,
        lookup.reference_order(), "cost", allowance,
    ).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("shown"))
    totals = refs.groupBy(*group).agg(F.count("*").alias("n"))
    more = F.col("n") - F.size("shown")
    text = F.concat_ws(
        "", F.lit(" ("), F.col("n").cast("string"), F.lit("):\n"),
        F.array_join(F.transform("shown", lambda s: s["text"]), ""),
        F.when(more > 0, F.concat(F.lit("  … "), more.cast("string"), F.lit(" more.\n"))),
    )
    return totals.join(listed, group).withColumn("text", text).groupBy("decl_key").agg(
        *[F.max(F.when(F.col("direction") == d, F.col("text"))).alias(d) for d in ("referenced_by", "references")]
    )


def for_address_text(ix: Index, address: str, char_budget: int = S.DEFAULT_LIST_BUDGET) -> str:
    decls, refs = ix.for_address(address)
    n = decls.count()
    if not n:
        return REFS_MISS.format(query=_quote(address), nodes=ix.totals["n_nodes"])
    limit = char_budget if char_budget > 0 else S.DEFAULT_CHAR_BUDGET
    lists = _reference_lists(refs, max(MIN_PER_DECLARATION, limit // n)).withColumnRenamed("decl_key", "node_key")
    none = F.lit(": none\n")
    text = F.concat(_identity(), F.lit("referenced by"), F.coalesce("referenced_by", none),
                    F.lit("references"), F.coalesce("references", none))
    chunks = cut(decls.join(lists, "node_key", "left").select(
        "module_dir", "address", "node_key", text.alias("text"), (F.octet_length(text) + 1).alias("cost")))
    kept, dropped = budget.fill(chunks, ["module_dir", "address", "node_key"], "cost", limit)
    return (REFS_HEAD.format(n=n, query=_quote(address)) + "".join("\n" + row["text"] for row in kept)
            + _omitted(dropped, "declaration(s)"))


def impact_text(ix: Index, address: str, direction: str = "dependents", depth: int = impact.DEFAULT_DEPTH,
                char_budget: int = S.DEFAULT_LIST_BUDGET) -> str:
    result = ix.impact(address, direction, depth)
    origin = result.origin.orderBy("module_dir", "address")
    # A type names its whole family; the list of origins is part of the answer's heading.
    heads = origin.select("address", A.location(F.col("file"), F.col("line")).alias("at")).collect()
    if not heads:
        return IMPACT_MISS.format(query=_quote(address))
    total = result.nodes.count()
    word = "required by" if direction == "dependencies" else "affected by changing"
    text = f"{total} node(s) {word} {address} (depth {depth}).\n"
    text += "".join(f"  origin: {row['address']}  {row['at']}\n" for row in heads)
    if not total:
        return text + IMPACT_NONE

    nodes = result.nodes
    if ix.instances is None:
        nodes = nodes.withColumns({"n_instances": F.lit(0), "replaced": F.lit(False)})
    else:
        per_node = ix.instances.groupBy("node_key").agg(
            F.count("*").alias("n_instances"), F.max(instances.replaces(F.col("actions"))).alias("replaced"))
        nodes = nodes.join(per_node, "node_key", "left").fillna(0, ["n_instances"]).fillna(False, ["replaced"])
    line = F.concat_ws(
        "", F.lit("  "), _padded(F.col("address"), 44), F.lit(" "), A.location(F.col("file"), F.col("line")),
        F.when(F.col("via.kind") != "REFERENCES", F.concat(F.lit("  ["), "via.kind", F.lit("]"))),
        F.when(F.col("replaced"), "  ** REPLACED **").when(
            F.col("n_instances") > 1, F.concat(F.lit("  ("), F.col("n_instances").cast("string"), F.lit(" instances)"))),
        F.lit("\n"),
    )
    lines = cut(nodes.select(*impact.impact_order(), line.alias("text"), F.octet_length(line).alias("cost")))
    left = (char_budget if char_budget > 0 else S.DEFAULT_CHAR_BUDGET) * 3 // 4
    dropped = 0
    for row in lines.select("depth").distinct().orderBy("depth").collect():
        head = f"\ndepth {row['depth']}:\n"
        if dropped or len(head) > left:
            dropped += not dropped
            break
        left -= len(head)
        level = lines.filter(F.col("depth") == row["depth"])
        kept, dropped = budget.fill(level, ["module_dir", "address", "node_key"], "cost", left)
        left -= sum(k["cost"] for k in kept)
        text += head + "".join(k["text"] for k in kept)
    text += _omitted(dropped, "node(s)") + _impact_caveat(ix, result)
    return text + (IMPACT_TRUNCATED.format(depth=depth) if result.truncated else "")


def _impact_caveat(ix: Index, result: impact.ImpactResult) -> str:
    """How much the answer knows: a plan, a state, or configuration alone."""
    known = impact.summary(result, ix.instances, ix.overlay.overlays if ix.overlay else None).first()
    if known["overlay_kind"] == "plan":
        names = [row["address"] for row in impact.replacing(result, ix.instances).orderBy("address").collect()]
        text = IMPACT_PLAN.format(n=known["instance_total"])
        if names:
            text += IMPACT_DESTROYED.format(n=len(names)) + "".join(f"  {name}\n" for name in names)
        else:
            text += IMPACT_IN_PLACE
        return text + IMPACT_STALE
    if known["overlay_kind"] == "state":
        return IMPACT_STATE.format(n=known["instance_total"])
    names = [row["address"] for row in impact.expanding(result).orderBy("address").collect()]
    return IMPACT_STATIC + (IMPACT_EXPANDING.format(n=len(names), names=", ".join(names)) if names else "")


def modules_text(ix: Index, filter_text: str = "", char_budget: int = S.DEFAULT_LIST_BUDGET) -> str:
    usage = cut(ix.modules(filter_text))
    total = usage.agg(F.count("*").alias("n"), F.count_if(F.col("n_versions") > 1).alias("skewed")).first()
    if not total["n"]:
        return NO_MODULES if not filter_text else MODULES_MISS.format(query=_quote(filter_text))

    nodes = ix.graph.nodes
    where = F.when(F.col("stack") == "", F.col("module_dir")).otherwise(F.col("stack"))
    site = F.concat(F.lit("    "), _padded(F.col("address"), 24), F.lit(" in "), _padded(where, 18), F.lit(" "),
                    A.location(F.col("file"), F.col("line")), F.lit("\n"))
    sites = modules.first_sites(nodes, filter_text, SITES_SHOWN).groupBy("source", F.col("pinned").alias("version")).agg(
        F.array_sort(F.collect_list(F.struct("rank", site.alias("text")))).alias("sites"))
    counted = modules.call_sites(nodes, filter_text).groupBy("source", F.col("pinned").alias("version")).agg(
        F.count("*").alias("n"))
    more = F.col("n") - F.size("sites")
    text = F.concat_ws(
        "", F.lit("  "), _padded(F.col("version"), 12), F.lit(" "), F.col("n").cast("string"), F.lit(" call site(s)\n"),
        F.array_join(F.transform("sites", lambda s: s["text"]), ""),
        F.when(more > 0, F.concat(F.lit("    … "), more.cast("string"), F.lit(" more call site(s)\n"))),
    )
    versions = cut(counted.join(sites, ["source", "version"]).select("source", "version", text.alias("text")))

    # Sources are measured before they are assembled: one that does not fit is never collected.
    note = F.when(F.col("local"), LOCAL_NOTE).when(F.col("n_versions") > 1, SKEW_NOTE).otherwise("")
    head = F.concat(F.lit("\n"), "source", note, F.lit("\n"))
    body = versions.groupBy("source").agg(F.sum(F.octet_length("text")).alias("body_cost"))
    chunks = cut(usage.join(body, "source").select(
        (-F.col("n_versions")).alias("rank"), "source", head.alias("head"),
        (F.octet_length(head) + F.col("body_cost")).alias("cost")))
    limit = char_budget if char_budget > 0 else S.DEFAULT_CHAR_BUDGET
    kept, dropped = budget.fill(chunks, ["rank", "source"], "cost", limit)
    bodies: dict[str, str] = {}
    for row in versions.filter(F.col("source").isin([k["source"] for k in kept])).orderBy("source", "version").collect():
        bodies[row["source"]] = bodies.get(row["source"], "") + row["text"]
    return (MODULES_HEAD.format(n=total["n"], skewed=total["skewed"])
            + "".join(k["head"] + bodies[k["source"]] for k in kept) + _omitted(dropped, "module source(s)"))


def orphans_text(ix: Index, char_budget: int = S.DEFAULT_LIST_BUDGET) -> str:
    line = F.concat(F.lit("  "), _padded(F.col("address"), 34), F.lit(" "),
                    _padded(A.location(F.col("file"), F.col("line")), 22), F.lit(" "), "reason", F.lit("\n"))
    head = F.concat(F.lit("\n"), F.when(F.col("module_dir") == "", ".").otherwise(F.col("module_dir")), F.lit("\n"))
    found = cut(ix.orphans().select(
        *orphans.orphan_order(), line.alias("text"), F.octet_length(line).alias("cost"),
        head.alias("head"), F.octet_length(head).alias("head_cost")))
    n = found.count()
    if not n:
        return NO_ORPHANS
    limit = char_budget if char_budget > 0 else S.DEFAULT_CHAR_BUDGET
    kept, dropped = budget.fill_grouped(found, orphans.orphan_order(), "cost", "module_dir", "head_cost", limit)
    text, current = ORPHANS_HEAD.format(n=n), None
    for row in kept:
        text += (row["head"] if row["module_dir"] != current else "") + row["text"]
        current = row["module_dir"]
    return text + _omitted(dropped, "orphan(s)")


def _count_lines(df: DataFrame, column: str) -> str:
    return "".join(f"  {row[column]:<22} {row['n']}\n" for row in df.collect())


def status_text(ix: Index, repo_root: str, builds: int = 1) -> str:
    """The shape of the snapshot; not budgeted, like the list of root modules it prints."""
    n = ix.totals
    text = (f"repo:      {repo_root}\nnodes:     {n['n_nodes']}\nedges:     {n['n_edges']}\n"
            f"roots:     {len(ix.root_dirs)}\nsnapshots: {builds} (rebuilt on any .tf change)\n\nroot modules:\n")
    text += "".join(f"  {_dot(r)}\n" for r in ix.root_dirs)
    text += "\nnodes by kind:\n" + _count_lines(counts.counts_by_kind(ix.graph.nodes), "kind")
    text += "\nedges by kind:\n" + _count_lines(counts.counts_by_edge_kind(ix.graph.edges), "kind")
    if n["n_unresolved"]:
        text += UNRESOLVED.format(n=n["n_unresolved"], edges=n["n_edges"])
    text += _overlay_status(ix)
    errors = [row["error"] for row in ix.graph.parse_errors.orderBy("file", "ord").collect()]
    if errors:
        text += f"\nparse errors ({len(errors)}):\n" + "".join(f"  {e}\n" for e in errors)
    return text


def _overlay_status(ix: Index) -> str:
    if ix.overlay is None or not ix.overlay.is_available():
        return NO_OVERLAY.format(reason=ix.unavailable_reason())
    text = "\nplan overlay:\n"
    for row in ix.overlay.sources:
        text += f"  {_dot(row['stack']):<24} {row['kind']:<6} {row['source']}\n"
    names = [_dot(r["module_dir"]) for r in counts.uncovered_roots(ix.graph.roots, ix.overlay.overlays).collect()]
    if names:
        text += UNCOVERED.format(n=len(names), names=", ".join(names))
    reason = ix.unavailable_reason()
    return text + (f"  warning: {reason}\n" if reason else "")
