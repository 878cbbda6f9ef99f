"""Planned or existing instances of configuration nodes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import node_key
from ..schema import INSTANCE_KINDS


def replaces(actions: Column) -> Column:
    """Destroyed and recreated, in either order."""
    return F.coalesce(
        F.array_contains(actions, "delete") & F.array_contains(actions, "create"), F.lit(False)
    )


def changes(actions: Column) -> Column:
    """Anything other than leaving or reading the instance."""
    return F.coalesce(F.exists(actions, lambda a: ~a.isin("no-op", "read")), F.lit(False))


def action_summary(actions: Column) -> Column:
    """'' without actions, 'replace' for a pair, else the actions joined by +."""
    return (
        F.when(actions.isNull() | (F.size(actions) == 0), "")
        .when(replaces(actions), "replace")
        .otherwise(F.array_join(actions, "+"))
    )


def instances_of(nodes: DataFrame, stack_paths: DataFrame, instances: DataFrame) -> DataFrame:
    """(node_key, stack, address, index_key, actions, action_reason) for resource-like nodes.

    Instances meet the paths first: a module path inside a stack leads to one directory, so
    that join adds no rows. Joining nodes to paths first would multiply a directory's nodes
    by its callers before the plan had a say.
    """
    located = instances.join(stack_paths, ["stack", "module_address"]).select(
        "module_dir", "config_address", "stack", "address", "index_key",
        "actions", "action_reason", "inst_seq",
    )
    wanted = (
        nodes.filter(F.col("kind").isin(*INSTANCE_KINDS))
        .select("module_dir", F.col("address").alias("config_address")).distinct()
        .withColumn("node_key", node_key(F.col("module_dir"), F.col("config_address")))
    )
    return located.join(wanted, ["module_dir", "config_address"]).select(
        "node_key", "stack", "address", "index_key", "actions", "action_reason", "inst_seq"
    )


def instance_order():
    return ["stack", "address", "inst_seq"]


def by_stack(instances: DataFrame) -> DataFrame:
    """(node_key, stack, n_instances, planned): counts and the sorted set of planned actions.

    The set has at most a handful of members, whatever the number of instances.
    """
    summary = action_summary(F.col("actions"))
    planned = F.when((summary != "") & (summary != "no-op"), summary)
    return instances.groupBy("node_key", "stack").agg(
        F.count("*").alias("n_instances"),
        F.array_sort(F.collect_set(planned)).alias("planned"),
    )
