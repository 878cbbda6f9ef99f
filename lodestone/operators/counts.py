"""Counts, stamps and coverage: the shape of a snapshot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """(column, n), largest first, then by key."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def counts_by_kind(nodes: DataFrame) -> DataFrame:
    return counts_by(nodes, "kind")


def counts_by_edge_kind(edges: DataFrame) -> DataFrame:
    return counts_by(edges, "kind")


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (n_nodes, n_edges, n_unresolved)."""
    return edges.agg(
        F.count("*").alias("n_edges"), F.count_if(F.col("to_key").isNull()).alias("n_unresolved")
    ).withColumn("n_nodes", nodes.agg(F.count("*")).scalar())


def fingerprint(files: DataFrame, modified: str, size: str) -> DataFrame:
    """One row (newest, n, total): changes when a file is edited, added or removed."""
    return files.agg(
        F.max(modified).alias("newest"), F.count("*").alias("n"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total"),
    )


def uncovered_roots(roots: DataFrame, overlays: DataFrame) -> DataFrame:
    """Root directories without an overlay."""
    stacks = overlays.select(F.col("stack").alias("module_dir"))
    return roots.join(stacks, "module_dir", "left_anti").orderBy("module_dir")
