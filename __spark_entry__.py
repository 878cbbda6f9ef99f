
from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestone.functions import address as A  # noqa: E402
from lodestone.functions import scoring as S  # noqa: E402
from lodestone.functions import text as X  # noqa: E402
from lodestone.operators import budget, counts, corpus, explore, impact, instances, lookup, modules, orphans  # noqa: E402
from lodestone.operators.keyed import KeyedGraph  # noqa: E402
from lodestone.operators.postings import PostingIndex  # noqa: E402
from lodestone.plans import layout  # noqa: E402
from lodestone.plans.load import Graph, load  # noqa: E402
from lodestone.sources import overlay  # noqa: E402
from lodestone.sources import tables as T  # noqa: E402
from oracle import sql as oracle  # noqa: E402

if all(importlib.util.find_spec(m) for m in ("lodestone.llm", "corpus_pipeline")):
    from lodestone.llm import queries as llm
else:
    llm = None  # the library works without its text pipeline

QUERY = oracle.QUERY
PART_QUERY = oracle.PART_QUERY

_graphs: dict = {}


def _trade_graph(spark: SparkSession, sf: str) -> Graph:
    """The graph of the configuration written from the tables, parsed once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _graphs:
        _graphs[key] = load(T.trade_files(spark, sf))
    return _graphs[key]


_overlays: dict = {}


def _line_overlay(spark: SparkSession, sf: str) -> overlay.Overlay:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _overlays:
        _overlays[key] = overlay.build(T.line_documents(spark, sf))
    return _overlays[key]


def _terms(spark, sf, name="documents", key="doc_id"):
    return T.table(spark, sf, name).select(key, X.tokens(F.col("text")).alias("terms"))


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# Text

def tokenize_counts(spark, sf):
    return _terms(spark, sf).select(
        "doc_id", F.size("terms").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("terms")).cast("long").alias("n_terms"),
    )


def stem_pairs(spark, sf):
    words = T.table(spark, sf, "documents").select(F.explode(F.array_distinct(X.words(F.col("text")))).alias("word"))
    words = words.filter(F.octet_length("word") >= X.MIN_TOKEN_BYTES).distinct()
    return words.select("word", X.stem(F.col("word")).alias("stem"))


def vectorized(spark, sf):
    pages = T.table(spark, sf, "pages")
    return X.vectorize(pages, "page_id", "html").select("page_id", "term", "weight")


def fused_postings(spark, sf):
    turns = T.table(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return X.vectorize_fused(turns, "id", "text")


def term_df(spark, sf):
    return corpus.document_frequency(_terms(spark, sf)).select("term", F.col("df").cast("long").alias("df"))


def corpus_stats(spark, sf):
    docs = _terms(spark, sf).withColumn("length", X.fused_length(F.col("terms")))
    return corpus.corpus_stats(docs).select(
        F.col("n_docs").cast("long").alias("n_docs"), F.round("total_length", 1).alias("total_length"),
        F.round("avg_length", 4).alias("avg_length"),
    )


def _corpus(spark, sf):
    return corpus.Corpus.build(T.document_nodes(spark, sf))


def idf_terms(spark, sf):
    """Every term with its rarity."""
    return _corpus(spark, sf).inverse_document_frequency().select(
        "term", F.col("df").cast("long").alias("df"), F.round("idf", 4).alias("idf"), "informative")


def rarity_weights(spark, sf):
    lines = T.table(spark, sf, "benchmark")
    vector = X.vectorize_fused(lines.withColumn("q", F.lit(0)), "q", "text").select("term", "weight")
    weighted = _corpus(spark, sf).weight_by_rarity(vector)
    return weighted.select("term", F.round("weight", 4).alias("weight"))


def turn_similarity(spark, sf):
    """Each turn of a conversation against the turn before it."""
    turns = T.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    both = turns.join(before, ["conv_id", "turn"]).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return X.similarity(both, "id", "text", "before").select("id", F.round("similarity", 4).alias("similarity"))


# Ranking

_postings: dict = {}


def _indexed(spark, sf, name: str, nodes) -> tuple:
    """Nodes and their kept index, built once per session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _postings:
        _postings[key] = PostingIndex.build(nodes)
    return nodes, _postings[key]


def _document_index(spark, sf):
    return _indexed(spark, sf, "documents", T.document_nodes(spark, sf))


def _part_index(spark, sf):
    return _indexed(spark, sf, "part", T.part_nodes(spark, sf))


def explore_documents(spark, sf):
    nodes, index = _document_index(spark, sf)
    result = explore.explore(nodes, QUERY, T.label_edges(spark, sf), max_nodes=10, index=index)
    return result.hits.select(
        "node_key", F.round("score", 4).alias("score"), F.col("excerpt.full_len").cast("long").alias("full_len"),
        F.col("excerpt.truncated").alias("truncated"), *_long("ref_count", "ref_by_count"),
    )


def explore_counters(spark, sf):
    nodes, index = _document_index(spark, sf)
    result = explore.explore(nodes, QUERY, max_nodes=25, char_budget=1800, index=index)
    return result.counters.select(*_long("considered", "above_threshold", "shown", "dropped_for_budget"))


def document_scores(spark, sf):
    scores = _document_index(spark, sf)[1].every_score(QUERY)
    return scores.select("node_key", F.round("score", 4).alias("score"))


def explore_parts(spark, sf):
    nodes, index = _part_index(spark, sf)
    result = explore.explore(nodes, PART_QUERY, max_nodes=25, index=index)
    return result.hits.select("node_key", "name", "type", F.round("score", 4).alias("score"))


def part_scores(spark, sf):
    scores = explore.score_nodes(corpus.Corpus.build(T.part_nodes(spark, sf)), PART_QUERY)
    return scores.select("node_key", F.round("score", 4).alias("score"))


def authority(spark, sf):
    nodes = T.document_nodes(spark, sf)
    rank = S.authority(F.col("kind"), F.col("file"), F.col("deprecated"))
    return nodes.select("node_key", F.round(rank, 4).alias("authority"), S.is_demoted(F.col("file")).alias("demoted"))


def excerpt(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", S.excerpt(F.col("text"), F.lit(600)).alias("e"))
    return docs.select(
        "doc_id", F.col("e.text").alias("text"), F.col("e.truncated").alias("truncated"),
        F.col("e.full_len").cast("long").alias("full_len"),
    )


# Graph

def node_counts(spark, sf):
    return counts.counts_by_kind(T.star_nodes(spark, sf))


def edge_counts(spark, sf):
    return counts.counts_by_edge_kind(T.star_edges(spark, sf))


def graph_totals(spark, sf):
    return counts.graph_totals(T.document_nodes(spark, sf), T.label_edges(spark, sf)).select(
        *_long("n_nodes", "n_edges", "n_unresolved"))


def unresolved_refs(spark, sf):
    edges = T.label_edges(spark, sf).filter(F.col("to_key").isNull())
    return edges.select("from_key", "unresolved")


_keyed: dict = {}


def _star_graph(spark, sf) -> KeyedGraph:
    """The tables as a graph laid out by key, once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _keyed:
        _keyed[key] = KeyedGraph.build(T.star_nodes(spark, sf), T.star_edges(spark, sf))
    return _keyed[key]


def _references(spark, sf, query):
    graph = _star_graph(spark, sf)
    found = lookup.references(graph, lookup.declarations(graph, query))
    return found.select("decl_key", "direction", "kind", "peer_key", "peer_address", "file", "line", "traversal")


def refs_by_address(spark, sf):
    return _references(spark, sf, "nation.3")


def refs_by_name(spark, sf):
    return _references(spark, sf, "ASIA")


def refs_by_type(spark, sf):
    return _references(spark, sf, "supplier")


def declarations(spark, sf):
    return lookup.declarations(_star_graph(spark, sf), "red widget").select("node_key", "kind", "name")


def _impact(spark, sf, address, direction, depth):
    return impact.impact(_star_graph(spark, sf), address, direction, depth)


def _reached(result):
    return result.nodes.select(
        "node_key", F.col("depth").cast("long").alias("depth"), F.col("via.kind").alias("via_kind"),
        F.col("via.from_key").alias("via_from"), F.col("via.to_key").alias("via_to"),
    )


def impact_dependents(spark, sf):
    return _reached(_impact(spark, sf, "region.0", "dependents", 3))


def impact_dependencies(spark, sf):
    return _reached(_impact(spark, sf, "orders", "dependencies", 2))


def impact_summary(spark, sf):
    """Totals of a walk that stops short, against lines as planned instances."""
    result = _impact(spark, sf, "nation.3", "dependents", 1)
    lines, paths = T.line_instances(spark, sf)
    found = instances.instances_of(T.star_nodes(spark, sf), paths, lines)
    overlays = paths.select("stack", F.lit("plan").alias("kind")).distinct()
    total = impact.summary(result, found, overlays)
    return total.select(
        F.col("instance_total").cast("long").alias("instance_total"), "overlay_kind",
        F.lit(result.truncated).alias("truncated"),
        impact.replacing(result, found).agg(F.count("*")).scalar().alias("n_replacing"),
        impact.expanding(result).agg(F.count("*")).scalar().alias("n_expanding"),
    )


def module_usage(spark, sf):
    return modules.module_usage(T.part_calls(spark, sf)).select("source", *_long("n_versions", "n_sites"), "local")


def module_versions(spark, sf):
    return modules.module_versions(T.part_calls(spark, sf)).select(
        "source", "version", *_long("n_sites", "n_versions"), "local")


def module_filter(spark, sf):
    return modules.module_usage(T.part_calls(spark, sf), "  RED ").select(
        "source", *_long("n_versions", "n_sites"), "local")


def module_first_sites(spark, sf):
    return modules.first_sites(T.part_calls(spark, sf)).select("source", "pinned", "node_key", F.col("rank").cast("long").alias("rank"))


def star_orphans(spark, sf):
    roots = spark.createDataFrame([("geo",)], "module_dir string")
    found = orphans.orphans(T.star_nodes(spark, sf), T.star_edges(spark, sf), roots)
    return found.select("node_key", "reason")


def instances_of(spark, sf):
    lines, paths = T.line_instances(spark, sf)
    found = instances.instances_of(T.star_nodes(spark, sf), paths, lines)
    return instances.by_stack(found).select(
        "node_key", "stack", F.col("n_instances").cast("long").alias("n_instances"),
        F.array_join("planned", ",").alias("planned"))


def instance_actions(spark, sf):
    action = "CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'create' ELSE 'no-op' END"
    orders = T.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.expr(f"collect_list({action})")).alias("actions"))
    a = F.col("actions")
    return orders.select(
        "l_orderkey", instances.replaces(a).alias("replaces"), instances.changes(a).alias("changes"),
        instances.action_summary(a).alias("summary"),
    )


# Layout

def roots(spark, sf):
    return layout.roots(T.trade_dirs(spark, sf), T.trade_calls(spark, sf), T.explicit_parts(spark, sf))


def owning_stacks(spark, sf):
    dirs, calls = T.trade_dirs(spark, sf), T.trade_calls(spark, sf)
    return layout.owning_stacks(dirs, layout.roots(dirs, calls, T.explicit_parts(spark, sf)), calls)


def stack_paths(spark, sf):
    dirs, calls = T.trade_dirs(spark, sf), T.trade_calls(spark, sf)
    return layout.stack_paths(layout.roots(dirs, calls, T.explicit_parts(spark, sf)), calls)


def local_targets(spark, sf):
    pages = T.table(spark, sf, "pages").selectExpr(
        "page_id", "concat('a/b', page_id) AS module_dir",
        "CASE page_id % 4 WHEN 0 THEN concat('../../c/./d', page_id, '/../e') WHEN 1 THEN concat('./x', page_id, '/') "
        "WHEN 2 THEN '../../../out' ELSE url END AS source")
    return pages.select("page_id", A.local_target(F.col("module_dir"), F.col("source")).alias("target"))


# Configuration text

def config_nodes(spark, sf):
    return _trade_graph(spark, sf).nodes.select(
        "node_key", "kind", "type", "name", "stack", "shared", "file", F.col("line").cast("long").alias("line"),
        F.col("end_line").cast("long").alias("end_line"), "doc", "has_count", "deprecated")


def config_edges(spark, sf):
    return _trade_graph(spark, sf).edges.select(
        "kind", "from_key", "to_key", "traversal", "unresolved", "file", F.col("line").cast("long").alias("line"))


def config_roots(spark, sf):
    return _trade_graph(spark, sf).roots


def config_stack_paths(spark, sf):
    return _trade_graph(spark, sf).stack_paths


def config_instances(spark, sf):
    g, planned = _trade_graph(spark, sf), T.trade_instances(spark, sf)
    found = instances.instances_of(g.nodes, g.planned_paths(planned), planned)
    return found.select("node_key", "stack", "address", "index_key")


def config_paths_into(spark, sf):
    wanted = T.table(spark, sf, "customer").filter("c_acctbal < 0").selectExpr(
        "concat('customers/c', c_custkey) AS module_dir")
    return _trade_graph(spark, sf).paths_into(wanted)


def config_orphans(spark, sf):
    g = _trade_graph(spark, sf)
    return orphans.orphans(g.nodes, g.edges, g.roots).select("node_key", "reason")


def config_modules(spark, sf):
    return modules.module_usage(_trade_graph(spark, sf).nodes).select("source", *_long("n_versions", "n_sites"), "local")


def config_impact(spark, sf):
    g = _trade_graph(spark, sf)
    return _reached(impact.impact(g.keyed, "nation", "dependents", 2))


# Overlay

def overlay_instances(spark, sf):
    return _line_overlay(spark, sf).instances.select(
        "stack", "module_address", "config_address", "address", "index_key",
        F.array_join("actions", "+").alias("actions"))


def overlay_sources(spark, sf):
    return _line_overlay(spark, sf).overlays


def overlay_failures(spark, sf):
    return _line_overlay(spark, sf).failures.select("source", "reason")


def overlay_pick(spark, sf):
    files = T.table(spark, sf, "documents").selectExpr(
        "source AS module_dir",
        "CASE lang WHEN 'en' THEN 'plan.json' WHEN 'de' THEN concat('a', doc_id, '.tfplan.json') "
        "WHEN 'fr' THEN 'tfstate.json' ELSE concat('doc', doc_id, '.json') END AS name",
        "concat(source, '/', lpad(cast(doc_id as string), 9, '0')) AS path")
    return overlay.discover(files, files.select("module_dir").distinct())


def uncovered_roots(spark, sf):
    dirs = T.table(spark, sf, "orders").selectExpr("concat('orders/o', o_orderkey) AS module_dir")
    return counts.uncovered_roots(dirs, _line_overlay(spark, sf).overlays)


def json_index(spark, sf):
    events = T.table(spark, sf, "events")
    return events.select("event_id", F.from_json("props", "k STRING")["k"].alias("index_key"))


def module_address_split(spark, sf):
    address = F.expr(
        "concat('module.o', l_orderkey, '[\"', l_returnflag, '.', l_linestatus, '\"].module.p', l_partkey, "
        "'[', l_linenumber, ']')")
    parts = T.table(spark, sf, "lineitem").select(address.alias("address"))
    segments = A.module_segments(F.col("address"))
    return parts.select(
        "address", A.normalize_module_address(F.col("address")).alias("normalized"),
        F.array_join(F.transform(segments, A.segment_key), "/").alias("keys"),
    )


# Budgets and stamps

def budget_prefix(spark, sf):
    docs = T.table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    shown = budget.listed_within(docs, ["source"], ["doc_id"], "n_chars", 4000)
    return shown.select("source", "doc_id", *_long("rank", "spent_before"))


def budget_greedy(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "n_chars")
    kept, dropped = budget.fill_table(docs, ["doc_id"], "n_chars", 20000)
    return kept.withColumn("dropped", F.lit(dropped).cast("long"))


def fingerprint(spark, sf):
    events = T.table(spark, sf, "events").withColumn("size", F.length("props").cast("long"))
    stamp = counts.fingerprint(events, "ts", "size")
    return stamp.select(F.col("newest").cast("string").alias("newest"), *_long("n", "total"))


def counts_sorted(spark, sf):
    return counts.counts_by(T.table(spark, sf, "events"), "event_type")


_QUERIES = [
    tokenize_counts, stem_pairs, vectorized, fused_postings, term_df, corpus_stats, idf_terms, rarity_weights,
    turn_similarity, explore_documents, explore_counters, document_scores, explore_parts, part_scores, authority,
    excerpt, node_counts, edge_counts, graph_totals, unresolved_refs, refs_by_address, refs_by_name, refs_by_type,
    declarations, impact_dependents, impact_dependencies, impact_summary, module_usage, module_versions,
    module_filter, module_first_sites, star_orphans, instances_of, instance_actions, roots, owning_stacks,
    stack_paths, local_targets, config_nodes, config_edges, config_roots, config_stack_paths, config_instances,
    config_paths_into, config_orphans,
    config_modules, config_impact, overlay_instances, overlay_sources, overlay_failures, overlay_pick,
    uncovered_roots, json_index, module_address_split, budget_prefix, budget_greedy, fingerprint, counts_sorted,
]


def entry(spark: SparkSession) -> DataFrame:
    """Ranked retrieval over the documents: tokens, BM25, identity, authority, floor, top-k."""
    return explore_documents(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {q.__name__: q for q in _QUERIES}
    return own if llm is None else own | llm.queries()


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql() if llm is None else oracle.all_sql() | llm.oracle_sql()
