"""Parquet tables presented as nodes, edges, calls and plan documents.

The operators cannot tell these from a parsed repository. Every adapter covers its whole
tables; sizes follow the tables.
"""

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGES, NODES

_DEFAULTS = {
    "type": "''", "name": "''", "stack": "''", "shared": "false", "file": "''", "line": "1",
    "end_line": "1", "body": "''", "doc": "''", "source": "''", "version": "''",
    "provider_alias": "''", "has_count": "false", "has_for_each": "false",
    "deprecated": "false", "sensitive": "false",
}


# Stated so that opening a table needs no job to read a file footer.
_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


# Tables whose rows cost much more to process than to read, and the keys to spread them by.
_SPREAD = {
    "documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "lineitem": ["l_orderkey"],
}
_SPREAD_BYTES_PER_CORE = 64 << 20
# Most bytes of a file that one task of a spread table gets; pages' terms are many times their rows.
_SPREAD_BYTES_PER_TASK = 4 << 20
# The same where a row becomes a file of text that is parsed.
_TEXT_BYTES_PER_TASK = 1 << 20
# Tables that are spread at any size, because a file's own splits may be whole row groups.
_SPREAD_ALWAYS = {"pages"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(_SCHEMAS[name]) if name in _SCHEMAS else spark.read
    df = reader.parquet(f"{folder}/{name}.parquet")
    return spread(df, f"{folder}/{name}.parquet", *_SPREAD[name], always=name in _SPREAD_ALWAYS) if name in _SPREAD else df


def spread(df: DataFrame, path: str, *keys: str, always: bool = False, per_task: int = _SPREAD_BYTES_PER_TASK) -> DataFrame:
    """Share a small input out over all cores; leave a large one as its files split it.

    A table of one row group is one task however many cores wait. Up to 64 MB per core the
    shuffle costs little; beyond that the scan has splits enough and nothing is moved, unless it is
    spread always. The number of tasks follows the size, so what one of them holds does not grow. The
    size comes from a listing, not from reading.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = _bytes(spark, path)
    tasks = max(cores, -(-size // per_task))
    return df.repartition(tasks, *keys) if always or size < cores * _SPREAD_BYTES_PER_CORE else df


@lru_cache(maxsize=256)
def _bytes(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def _project(df: DataFrame, schema, exprs: dict) -> DataFrame:
    return df.selectExpr(*[
        f"CAST({exprs[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema
    ])


def as_nodes(df: DataFrame, seq: str, **columns: str) -> DataFrame:
    """SQL expressions for some node columns; the rest get the absent value."""
    return _project(df, NODES, {
        **_DEFAULTS, **columns,
        "node_key": f"concat({columns['module_dir']}, '|', {columns['address']})",
        "node_seq": f"lpad(cast({seq} as string), 12, '0')",
    })


def as_edges(df: DataFrame, **columns: str) -> DataFrame:
    return _project(df, EDGES, {"unresolved": "''", "traversal": "''", "file": "''", "line": "1", **columns})


def _id(column: str) -> str:
    return f"cast({column} as string)"


def star_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """region nation customer supplier orders part as one graph's nodes."""
    def t(name):
        return table(spark, folder, name)

    parts = [
        as_nodes(t("region"), "r_regionkey", kind="'stack'", module_dir="'geo'", type="'region'",
                 address=f"concat('region.', {_id('r_regionkey')})", name="r_name"),
        as_nodes(t("nation"), "n_nationkey", kind="'local'", module_dir="'geo'", type="'nation'",
                 address=f"concat('nation.', {_id('n_nationkey')})", name="n_name"),
        as_nodes(t("customer"), "c_custkey", kind="'module'", module_dir="'sales'", type="'customer'",
                 address=f"concat('customer.', {_id('c_custkey')})", name="c_name",
                 has_for_each="c_acctbal < 0"),
        as_nodes(t("supplier"), "s_suppkey", kind="'resource'", module_dir="'supply'", type="'supplier'",
                 address=f"concat('supplier.', {_id('s_suppkey')})", name="s_name",
                 has_count="s_acctbal > 0"),
        as_nodes(t("orders"), "o_orderkey", kind="'output'", module_dir="'sales'", type="'orders'",
                 address=f"concat('orders.', {_id('o_orderkey')})", name="o_orderpriority"),
        as_nodes(t("part"), "p_partkey", kind="'variable'", module_dir="'supply'", type="'part'",
                 address=f"concat('part.', {_id('p_partkey')})", name="p_name"),
    ]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return nodes


def star_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Foreign keys as edges, from the row that names the key to the row it names."""
    def t(name):
        return table(spark, folder, name)

    def seq(rank, *keys):
        padded = ", ".join(f"lpad({_id(k)}, 12, '0')" for k in keys)
        return f"concat_ws('|', '{rank}', {padded})"

    def key(scope, kind, column):
        return f"concat('{scope}|{kind}.', {_id(column)})"

    lines = t("lineitem")
    read_kind = (
        "CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'REFERENCES' "
        "WHEN l_returnflag = 'A' THEN 'INPUTS' ELSE 'DEPENDS_ON' END"
    )
    parts = [
        as_edges(t("nation"), edge_seq=seq(1, "n_nationkey"), kind="'REFERENCES'",
                 from_key=key("geo", "nation", "n_nationkey"), to_key=key("geo", "region", "n_regionkey"),
                 file="'geo/nation'", line="n_nationkey"),
        as_edges(t("customer"), edge_seq=seq(2, "c_custkey"), kind="'REFERENCES'",
                 from_key=key("sales", "customer", "c_custkey"), to_key=key("geo", "nation", "c_nationkey"),
                 file="'sales/customer'", line="c_custkey", traversal="c_mktsegment"),
        as_edges(t("supplier"), edge_seq=seq(3, "s_suppkey"), kind="'PROVIDES'",
                 from_key=key("supply", "supplier", "s_suppkey"), to_key=key("geo", "nation", "s_nationkey"),
                 file="'supply/supplier'", line="s_suppkey"),
        as_edges(t("orders"), edge_seq=seq(4, "o_orderkey"), kind="'CALLS'",
                 from_key=key("sales", "orders", "o_orderkey"), to_key=key("sales", "customer", "o_custkey"),
                 file="'sales/orders'", line="0", traversal="o_orderstatus"),
        # A line names a part and a supplier: both edges come from one pass over the lines.
        as_edges(
            lines.select("*", F.expr(
                "inline(array(named_struct('rank', 5, 'peer', 'supply|part.', 'id', l_partkey, 'read', true), "
                "named_struct('rank', 6, 'peer', 'supply|supplier.', 'id', l_suppkey, 'read', false)))")),
            edge_seq=f"concat_ws('|', {_id('rank')}, " + ", ".join(
                f"lpad({_id(k)}, 12, '0')" for k in ("l_orderkey", "l_linenumber", "id")) + ")",
            kind=f"CASE WHEN read THEN {read_kind} ELSE 'DEPENDS_ON' END",
            from_key=key("sales", "orders", "l_orderkey"), to_key=f"concat(peer, {_id('id')})",
            file="'sales/lineitem'", line="l_linenumber", traversal="CASE WHEN read THEN l_linestatus ELSE '' END",
        ),
    ]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return edges


def document_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """documents as nodes with a body; toxic ones are deprecated, German ones illustrative."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    docs = table(spark, folder, "documents").join(labels, "doc_id", "left")
    return as_nodes(
        docs, "doc_id", kind="CASE WHEN n_chars < 200 THEN 'import' ELSE 'resource' END",
        module_dir="source", address=f"concat(lang, '.d', {_id('doc_id')})", type="lang",
        name=f"concat('d', {_id('doc_id')})", body="text", deprecated="coalesce(toxic = 1, false)",
        file="concat(CASE WHEN lang = 'de' THEN 'examples/' ELSE 'docs/' END, source, '.txt')",
    )


def label_edges(spark: SparkSession, folder: str) -> DataFrame:
    """One edge per document to its label; documents without a label stay unresolved."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang")
    labels = table(spark, folder, "labels").select("doc_id", F.lit(True).alias("known"))
    return as_edges(
        docs.join(labels, "doc_id", "left"), edge_seq="lpad(cast(doc_id as string), 12, '0')",
        kind="'REFERENCES'", from_key=f"concat(source, '|', lang, '.d', {_id('doc_id')})",
        to_key=f"CASE WHEN known THEN concat('labels|label.', {_id('doc_id')}) END",
        unresolved=f"CASE WHEN known THEN '' ELSE concat('label.', {_id('doc_id')}) END",
    )


def part_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """part as catalogue entries with an identity and a short body."""
    return as_nodes(
        table(spark, folder, "part"), "p_partkey", kind="'data'", module_dir="p_brand", type="p_type",
        address=f"concat('part.p', {_id('p_partkey')})", name="p_name",
        body=f"concat(p_name, ' size ', {_id('p_size')}, ' ', p_type, ' ', p_brand)", file="p_brand",
    )


def part_calls(spark: SparkSession, folder: str) -> DataFrame:
    """part as module calls: source by type and size, version by brand, some unpinned."""
    return as_nodes(
        table(spark, folder, "part"), "p_partkey", kind="'module'", module_dir="p_brand",
        address=f"concat('module.p', {_id('p_partkey')})", name="p_name", line="p_size",
        source="CASE WHEN p_size > 25 THEN concat('./', lower(p_type)) ELSE p_type END",
        version="CASE WHEN p_size % 7 = 0 THEN '' ELSE p_brand END", file="p_brand",
    )


def trade_dirs(spark: SparkSession, folder: str) -> DataFrame:
    """(module_dir): one directory per customer, order, part and supplier."""
    def dirs(name, prefix, column):
        return table(spark, folder, name).select(
            F.concat(F.lit(prefix), F.col(column).cast("string")).alias("module_dir")
        )

    return (
        dirs("customer", "c", "c_custkey").unionByName(dirs("orders", "o", "o_orderkey"))
        .unionByName(dirs("part", "p", "p_partkey")).unionByName(dirs("supplier", "s", "s_suppkey"))
    )


def trade_calls(spark: SparkSession, folder: str) -> DataFrame:
    """(module_dir, name, target): customers call their orders, orders call their parts."""
    placed = table(spark, folder, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("module_dir"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"),
    )
    filled = table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("module_dir"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"),
    )
    return placed.unionByName(filled).withColumn("target", F.col("name"))


def explicit_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(module_dir): parts of the largest size declare themselves roots."""
    return table(spark, folder, "part").filter("p_size = 50").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("module_dir")
    )


def _text_file(df: DataFrame, module_dir: str, name: str, content: str) -> DataFrame:
    """(module_dir, file, content) from SQL expressions over one table row."""
    return df.select(
        F.expr(module_dir).alias("module_dir"),
        F.concat(F.expr(module_dir), F.lit("/"), F.expr(name)).alias("file"),
        F.expr(content).alias("content"),
    )


def _lines(*lines: str) -> str:
    """A SQL expression that joins line expressions with newlines; NULL lines drop out."""
    return "concat_ws('\\n', " + ", ".join(lines) + ", '')"


def trade_files(spark: SparkSession, folder: str) -> DataFrame:
    """Configuration text written by Spark from the tables, one file per row.

    A nation is a root module that calls one child module per customer; a customer's
    directory holds one file per order. Nothing is grouped, so no file grows with the data.

    The rows are spread before their text is written, over as many tasks as their bytes ask for at
    any size: a row's text is many times the row, and reading it costs more still.
    """
    def rows(name, *columns):
        path = f"{folder}/{name}.parquet"
        return spread(table(spark, folder, name).select(*columns), path, columns[0], always=True, per_task=_TEXT_BYTES_PER_TASK)

    customer = rows("customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nations = _text_file(
        table(spark, folder, "nation"), f"concat('nations/n', {_id('n_nationkey')})", "'main.tf'",
        _lines(
            "concat('# ', n_name)", "'terraform {'", "'  backend \"s3\" {}'", "'}'", "''",
            "'provider \"market\" {'", "'  alias = \"main\"'", "'}'", "''",
            "'locals {'", "concat('  name = \"', n_name, '\"')", "'}'", "''",
            "'module \"market\" {'", "'  source  = \"registry/market/core\"'",
            f"concat('  version = \"4.$', '{{', cast(n_nationkey % 3 as string), '}}.0\"')",
            "'  label   = local.name'", "'}'", "''",
            # A heredoc and a conditional of constants.
            "'module \"feed\" {'", "'  source  = <<-EOT'", "'    registry/feed'", "'  EOT'",
            "concat('  version = (!(1 == 2) ? \"1.$', '{1 + 1}\" : \"0\")')", "'}'",
        ),
    )
    calls = _text_file(
        customer, f"concat('nations/n', {_id('c_nationkey')})",
        f"concat('c', {_id('c_custkey')}, '.tf')",
        _lines(
            f"concat('module \"c', {_id('c_custkey')}, '\" {{')",
            f"concat('  source  = \"../../customers/c', {_id('c_custkey')}, '\"')",
            "'  nation  = local.name'", "concat('  segment = \"', c_mktsegment, '\"')", "'  unknown = 1'",
            "'  providers = { market = market.main }'", "'}'",
            f"concat('output \"c', {_id('c_custkey')}, '_id\" {{')",
            f"concat('  value = module.c', {_id('c_custkey')}, '.id')", "'}'",
        ),
    )
    customers = _text_file(
        customer, f"concat('customers/c', {_id('c_custkey')})", "'main.tf'",
        _lines(
            "'variable \"nation\" {'", "'  type = string'", "'}'", "'variable \"segment\" {}'", "''",
            "'# customer.this in a comment is not a reference.'", "'resource \"customer\" \"this\" {'",
            "CASE WHEN c_acctbal < 0 THEN '  count  = 2' ELSE '  # one' END", "'  nation = var.nation'",
            "concat('  note   = \"customer.this $', '{var.nation}\"')", "'}'", "''",
            "'output \"id\" {'", "'  value = customer.this.id'", "'}'",
        ),
    )
    orders = _text_file(
        rows("orders", "o_orderkey", "o_custkey", "o_orderstatus"), f"concat('customers/c', {_id('o_custkey')})",
        f"concat('o', {_id('o_orderkey')}, '.tf')",
        _lines(
            f"concat('resource \"orders\" \"o', {_id('o_orderkey')}, '\" {{')",
            "'  customer = customer.this.id'", "concat('  status   = \"', o_orderstatus, '\"')",
            "'  dynamic \"line\" {'", "'    for_each = var.lines'", "'    content {'",
            "'      number = line.value.number'", "'    }'", "'  }'",
            "'  lifecycle {'", "'    replace_triggered_by = [customer.this]'", "'  }'", "'}'",
            "CASE WHEN o_orderstatus = 'P' THEN concat('moved {\\n  from = orders.old', "
            f"{_id('o_orderkey')}, '\\n  to   = orders.o', {_id('o_orderkey')}, '\\n}}') END",
        ),
    )
    return nations.unionByName(calls).unionByName(customers).unionByName(orders)


def line_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, stack, source, content): a show document per order, written from its lines.

    Open orders have a plan, filled ones a state with child modules, pending ones neither.
    A group is one order's lines.
    """
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey"
    )
    module = f"concat('module.lines[\"p.', {_id('l_partkey')}, '\"]')"
    actions = (
        "CASE l_returnflag WHEN 'R' THEN array('delete', 'create') WHEN 'A' THEN array('update') "
        "ELSE array('no-op') END"
    )
    address = f"concat({module}, '.item.line[', {_id('l_linenumber')}, ']')"
    resource = (
        f"'address', {address}, 'mode', 'managed', 'type', 'item', 'name', 'line', 'index', l_linenumber"
    )
    docs = lines.groupBy("l_orderkey", "o_orderstatus").agg(
        F.expr(f"collect_list(named_struct({resource}, 'module_address', {module}, "
               f"'change', named_struct('actions', {actions})))").alias("changes"),
        F.expr(f"collect_list(named_struct('address', {module}, "
               f"'resources', array(named_struct({resource}))))").alias("children"),
    )
    content = (
        "CASE o_orderstatus WHEN 'O' THEN to_json(named_struct('terraform_version', '1.6', 'resource_changes', changes)) "
        "WHEN 'F' THEN to_json(named_struct('terraform_version', '1.5', 'values', named_struct('root_module', "
        "named_struct('resources', array(named_struct('address', 'orders.this', 'mode', 'managed', 'type', 'orders', "
        "'name', 'this')), 'child_modules', children)))) ELSE '{\"format_version\":\"1.0\"}' END"
    )
    return docs.select(
        F.lit(0).alias("pos"), F.expr(f"concat('orders/o', {_id('l_orderkey')})").alias("stack"),
        F.expr(f"concat('orders/o', {_id('l_orderkey')}, '/show.json')").alias("source"), F.expr(content).alias("content"),
    )


def line_instances(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(instances, stack_paths): lines as instances of their suppliers, one stack per return flag."""
    lines = table(spark, folder, "lineitem")
    instances = lines.selectExpr(
        "concat('r', l_returnflag) AS stack", "concat('module.s', l_linestatus) AS module_address",
        f"concat('supplier.', {_id('l_suppkey')}) AS config_address",
        f"concat('line.', {_id('l_orderkey')}, '[', {_id('l_linenumber')}, ']') AS address",
        f"{_id('l_linenumber')} AS index_key",
        "CASE WHEN l_discount > 0.05 THEN array('delete', 'create') ELSE array('update') END AS actions",
        "'' AS action_reason", "'' AS inst_seq",
    )
    paths = instances.select("stack", "module_address").distinct().withColumn("module_dir", F.lit("supply"))
    return instances, paths


def trade_instances(spark: SparkSession, folder: str) -> DataFrame:
    """Planned instances of the configuration that trade_files writes: customers, their orders, their modules."""
    customers = table(spark, folder, "customer").selectExpr(
        f"concat('nations/n', {_id('c_nationkey')}) AS stack", f"concat('module.c', {_id('c_custkey')}) AS called",
        "c_custkey AS o_custkey", "c_acctbal")
    rest = ("array('update') AS actions", "'' AS action_reason", "'' AS inst_seq")
    modules = customers.selectExpr(
        "stack", "'' AS module_address", "called AS config_address", "called AS address", "'' AS index_key", *rest)
    inside = customers.selectExpr(
        "stack", "called AS module_address", "explode(IF(c_acctbal < 0, array('0', '1'), array(''))) AS index_key",
        "'customer.this' AS config_address",
    ).selectExpr(
        "stack", "module_address", "config_address",
        "concat(module_address, '.customer.this', IF(index_key = '', '', concat('[', index_key, ']'))) AS address",
        "index_key", *rest)
    orders = table(spark, folder, "orders").join(customers, "o_custkey").selectExpr(
        "stack", "called AS module_address", f"concat('orders.o', {_id('o_orderkey')}) AS config_address",
        f"concat(called, '.orders.o', {_id('o_orderkey')}) AS address", "'' AS index_key", *rest)
    return modules.unionByName(inside).unionByName(orders)
