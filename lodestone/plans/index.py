"""The six questions over one snapshot."""

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import counts, explore, impact, instances, lookup, modules, orphans
from ..operators.corpus import Corpus
from ..operators.postings import PostingIndex
from ..runtime import cut, generation, keep, owned_by
from ..sources import overlay as ov
from .load import Graph


class Index:
    """A graph, its term statistics, and optionally an overlay. Never changed once built.

    `facts` owns the overlay's tables as `graph.tables` owns the graph's. An Index holds both, so its
    DataFrames can be read for as long as the Index itself is referred to.
    """

    def __init__(self, spark: SparkSession, graph: Graph, overlay: ov.Overlay | None = None,
                 reason: str = ov.NOT_SUPPLIED, postings: PostingIndex | None = None, facts: generation | None = None):
        self.spark, self.graph, self.overlay, self.reason, self.facts = spark, graph, overlay, reason, facts
        with owned_by(graph.tables):
            self.postings = postings or PostingIndex.build(graph.nodes)
        for tables in filter(None, (graph.tables, facts)):
            tables.hold(self)

    @property
    def corpus(self) -> Corpus:
        """Every node's terms, for statistics over all of them."""
        return Corpus.build(self.graph.nodes)

    def with_overlay(self, overlay: ov.Overlay | None, facts: generation | None = None) -> "Index":
        """The same configuration with other plan facts; its postings are shared."""
        return Index(self.spark, self.graph, overlay, ov.NONE_FOUND, self.postings, facts)

    @cached_property
    def root_dirs(self) -> list[str]:
        return [row["module_dir"] for row in self.graph.roots.orderBy("module_dir").collect()]

    @cached_property
    def totals(self):
        return counts.graph_totals(self.graph.nodes, self.graph.edges).first()

    @cached_property
    def instances(self) -> DataFrame | None:
        """Every node's instances, or None without a usable overlay."""
        if self.overlay is None or not self.overlay.is_available():
            return None
        paths = self.graph.planned_paths(self.overlay.instances)
        with owned_by(self.facts):
            return keep(instances.instances_of(self.graph.nodes, paths, self.overlay.instances), "node-instances")

    def unavailable_reason(self) -> str:
        return self.reason if self.overlay is None else self.overlay.unavailable_reason()

    def explore(self, query: str, max_nodes: int = 5, char_budget: int = S.DEFAULT_CHAR_BUDGET):
        keyed = self.graph.keyed
        found = explore.explore(keyed.nodes.drop("first", "last"), query, keyed.outgoing, max_nodes=max_nodes,
                                char_budget=char_budget, index=self.postings, incoming=keyed.incoming)
        return replace(found, instances=self.instances_of(found.hits))

    def for_address(self, query: str):
        """(declarations, references) of an address, a name or a type."""
        decls = cut(lookup.declarations(self.graph.keyed, query))
        return decls, lookup.references(self.graph.keyed, decls)

    def impact(self, address: str, direction: str = "dependents", depth: int = impact.DEFAULT_DEPTH):
        graph = self.graph.keyed
        with owned_by(self.graph.tables):  # an answer goes with its snapshot
            found = impact.impact(graph, address, direction, depth)
        touched = found.origin.select("node_key").unionByName(found.nodes.select("node_key"))
        return replace(found, instances=self.instances_of(touched))

    def modules(self, filter_text: str = "") -> DataFrame:
        """(source, n_versions, n_sites, local) per source."""
        return modules.module_usage(self.graph.nodes, filter_text)

    def module_versions(self, filter_text: str = "") -> DataFrame:
        """(source, version, n_sites, n_versions, local) per source and version; no version is UNPINNED."""
        return modules.module_versions(self.graph.nodes, filter_text)

    def module_sites(self, filter_text: str = "") -> DataFrame:
        """(source, version, address, stack, module_dir, file, line) of every call, as rows."""
        return modules.call_sites(self.graph.nodes, filter_text).select(
            "source", F.col("pinned").alias("version"), "address", "stack", "module_dir", "file", "line",
        ).orderBy("source", "version", "module_dir", "address", "file", "line")

    def orphans(self) -> DataFrame:
        return orphans.orphans(self.graph.nodes, self.graph.edges, self.graph.roots)

    def instances_of(self, nodes: DataFrame) -> DataFrame | None:
        """Instances of some nodes only; they are few, so they filter by broadcast when Spark sees fit."""
        if self.instances is None:
            return None
        return self.instances.join(nodes.select("node_key"), "node_key", "left_semi")

    def views(self, prefix: str = "") -> None:
        """Register nodes, edges, roots, stack_paths (and instances) for spark.sql.

        This lists every module path; `graph.planned_paths` and `graph.paths_into` do not.
        """
        tables = {"nodes": self.graph.nodes, "edges": self.graph.edges, "roots": self.graph.roots,
                  "stack_paths": self.graph.stack_paths, "instances": self.instances}
        for name, df in tables.items():
            if df is not None:
                df.createOrReplaceTempView(prefix + name)
