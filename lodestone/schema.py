"""Closed vocabularies and table schemas shared by every operator."""

from pyspark.sql import types as T

# The closed set of node kinds.
NODE_KINDS = (
    "resource", "data", "module", "variable", "output", "local",
    "provider", "moved", "removed", "import", "stack", "module_source",
)

# The closed set of edge kinds. CONTAINS is declared and never emitted.
EDGE_KINDS = (
    "REFERENCES", "DEPENDS_ON", "CALLS", "PROVIDES",
    "INPUTS", "MOVED_FROM", "REPLACE_TRIGGERED_BY", "CONTAINS",
)

# What an overlay file can be, and the two ways to walk the graph.
OVERLAY_KINDS = ("plan", "state", "none")
DIRECTIONS = ("dependents", "dependencies")

# Kinds that have planned instances, and kinds that only describe state moves.
INSTANCE_KINDS = ("resource", "data", "module")
LIFECYCLE_KINDS = ("moved", "removed", "import")

# '' (never NULL) marks an absent string in nodes; an unresolved edge has a NULL to_key so
# that joins on it skip the row. *_seq columns are opaque strings that sort in load order.
NODES = T.StructType([
    T.StructField("node_key", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("module_dir", T.StringType()),
    T.StructField("stack", T.StringType()),
    T.StructField("shared", T.BooleanType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("body", T.StringType()),
    T.StructField("doc", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("provider_alias", T.StringType()),
    T.StructField("has_count", T.BooleanType()),
    T.StructField("has_for_each", T.BooleanType()),
    T.StructField("deprecated", T.BooleanType()),
    T.StructField("sensitive", T.BooleanType()),
    T.StructField("node_seq", T.StringType()),
])

EDGES = T.StructType([
    T.StructField("edge_seq", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("from_key", T.StringType()),
    T.StructField("to_key", T.StringType()),
    T.StructField("traversal", T.StringType()),
    T.StructField("unresolved", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
])

STACK_PATHS = T.StructType([
    T.StructField("module_dir", T.StringType()),
    T.StructField("stack", T.StringType()),
    T.StructField("module_address", T.StringType()),
])

INSTANCES = T.StructType([
    T.StructField("stack", T.StringType()),
    T.StructField("module_address", T.StringType()),
    T.StructField("config_address", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("index_key", T.StringType()),
    T.StructField("actions", T.ArrayType(T.StringType())),
    T.StructField("action_reason", T.StringType()),
    T.StructField("inst_seq", T.StringType()),
])

OVERLAYS = T.StructType([
    T.StructField("stack", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("terraform_version", T.StringType()),
])

NODE_COLUMNS = NODES.fieldNames()
EDGE_COLUMNS = EDGES.fieldNames()
