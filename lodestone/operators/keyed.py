"""A graph laid out by key: what a lookup reads is its own rows.

Nodes are sorted by key and say whether they are the first or last declaration of it. What a node is called
(address, name, type) and the edges, once by either end, lie in folders by a hash of the key and are sorted
inside each task's file: nothing is moved for them, and an end that a third of all edges share is many files.
A walk needs the order of the edges at each end, so the edges of its direction are sorted by that end and
numbered when a walk first asks for them. What no question reads is not laid out.

Few keys are literals in the filter, which then reaches folders, row groups and pages. More than that
are a semi-join: the same rows, by one pass over the table, which moves only where the keys are too many to send.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import detached, generation, keep, numbered, owner, scope, weighed

#: Most keys that become literals, bytes of a row group, and folders.
LITERALS = 200
GROUP = 1 << 20
FOLDERS = 16

#: How a node can be meant, best first.
CALLED = ("address", "name", "type")


@dataclass(frozen=True)
class KeyedGraph:
    """nodes by node_key; called(called, how, node_key); outgoing by from_key, incoming by to_key.

    Edge tables are written when first read; `tables` owns them then, whatever block is open.
    """

    nodes: DataFrame
    called: DataFrame
    edges: DataFrame
    n_edges: int
    tables: generation | None = None

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame) -> "KeyedGraph":
        within = owner()
        with scope(nodes.sparkSession) as kept:
            # One shuffle sorts by key; a key's declarations meet in one task, which streams them.
            same = Window.partitionBy("node_key").orderBy("node_seq")
            unknown = F.col("node_key").isNull()
            flagged = nodes.repartitionByRange("node_key").select("*", F.row_number().over(same).alias("_at"), F.lead(F.lit(1)).over(same).alias("_more"))
            flagged = flagged.withColumns({"first": unknown | (F.col("_at") == 1), "last": unknown | F.col("_more").isNull()}).drop("_at", "_more")
            placed = kept.result(flagged, "nodes-by-key", group_bytes=GROUP)
            names = placed.select("node_key", F.posexplode(F.array(*CALLED)).alias("how", "called")).filter("called <> ''")
            called = kept.result(_foldered(names, "called", "how", "node_key"), "called", group_bytes=GROUP, partition_by="folder")
        return cls(placed, called, edges, edges.count(), within if isinstance(within, generation) else None)

    @cached_property
    def outgoing(self) -> DataFrame:
        return self._by_end("from_key")

    @cached_property
    def incoming(self) -> DataFrame:
        return self._by_end("to_key")

    @cached_property
    def steps_out(self) -> DataFrame:
        return self._numbered("from_key", "to_key")

    @cached_property
    def steps_in(self) -> DataFrame:
        return self._numbered("to_key", "from_key")

    def _by_end(self, at: str) -> DataFrame:
        edges = _foldered(self.edges.filter(F.col(at).isNotNull()), at, "edge_seq")
        with detached(self.tables):
            return keep(edges, f"edges-by-{at}", partition_by="folder", group_bytes=GROUP)

    def _numbered(self, at: str, peer: str) -> DataFrame:
        """Edges between known ends, sorted by one end and numbered (`no`) in load order there."""
        with detached(self.tables):
            return numbered(self.edges.filter("to_key IS NOT NULL"), [at, "edge_seq", "kind", peer], f"edges-at-{at}")[0]

    def declared(self, keys: DataFrame, last: bool = True) -> DataFrame:
        """One node for each of the keys (node_key): its last declaration in load order, or its first."""
        one = self.nodes.filter("last" if last else "first")
        return restrict(one, "node_key", keys).drop("first", "last")


def folder(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


def _foldered(df: DataFrame, key: str, *then: str) -> DataFrame:
    return df.withColumn("folder", folder(F.col(key))).sortWithinPartitions("folder", key, *then)


def literals(keys: DataFrame) -> list | None:
    """The distinct keys of a one-column table, or None if they are more than LITERALS."""
    few = keys.limit(LITERALS + 1).collect()
    return [row[0] for row in few] if len(few) <= LITERALS else None


def restrict(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of `table` whose `column` is among `keys`, a kept table of one column of distinct keys."""
    few = literals(keys)
    if few is not None:
        found = table.filter(F.col(column).isin(few))
        if "folder" not in table.columns:
            return found
        return found.filter(F.col("folder").isin([folder(F.lit(k)) for k in few]) if few else F.lit(False))
    return among(table, column, weighed(keys))


def among(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of `table` whose `column` is one of any number of keys."""
    return table.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")
