"""What the load of a configuration costs: statements read in one step, tables made when asked for, tasks by size."""

import pytest

from lodestone.plans.load import load
from lodestone.sources import hcl
from lodestone.sources import tables as T

PLAIN = '''# A lighthouse.
resource "lamp" "top" {
  watts = 1000
  lens  = var.lens["big"].glass[0] # ground
  on    = true

  // kept
  label = "north ${var.place} of ${local.sea}"
  needs = [tower.base, "rope", var.oil]
  lifecycle { }
}
'''
ODD = [
    PLAIN, "a = 1\n", "b \"x\" {\n  c = null\n  d = for\n  e = [for]\n  f = [true, g]\n}\n", "locals {\n  # why\n  a = \"x\"\n  b = c.d\n}\n",
    "r {\n  a = \"$${b}\"\n  c = \"${true}\"\n  d = e . f\n  g = h.0i\n  j = \"k\n}\n", "}\nr {}\n", "r {\r\n  a = \"b\" \r\n}\r\n",
    "r \"${a}\" {\n}\n", "m n {\n x = y(z)\n}\n", "r {\n  a = b.c\n  /* d\n */ e = 1.5e3\n}\n", "r {\n  a == 2\n  b.c = 1\n}\n", "r {\n",
]


def test_plain_statements_take_one_step(monkeypatch):
    tokens = []
    token = hcl._Scan.token
    monkeypatch.setattr(hcl._Scan, "token", lambda self, frame, pos: tokens.append(pos) or token(self, frame, pos))
    blocks, errors = hcl.scan_text(PLAIN)
    assert not errors and [r["raw"] for a in blocks[0]["attrs"] for r in a["refs"]] == [
        "var.lens[\"big\"].glass[0]", "var.place", "local.sea", "tower.base", "var.oil"]
    assert len(tokens) <= 2


@pytest.mark.parametrize("text", ODD)
def test_a_statement_in_one_step_is_what_its_tokens_say(monkeypatch, text):
    found = hcl.scan_text(text)
    monkeypatch.setattr(hcl._Scan, "statement", lambda self, frame, pos: 0)
    assert hcl.scan_text(text) == found


def test_roots_and_paths_need_neither_nodes_nor_edges(spark):
    files = spark.createDataFrame([
        ("top", "top/main.tf", 'module "a" {\n  source = "../sub"\n}\n'),
        ("sub", "sub/main.tf", 'resource "r" "x" {\n  y = var.z\n}\nvariable "z" {}\n'),
        ("bare", "bare/main.tf", ""), ("bad", "bad/main.tf", "r {\n"),
    ], "module_dir string, file string, content string")
    graph = load(files)
    assert {r["module_dir"] for r in graph.roots.collect()} == {"top", "bare", "bad"}
    into = graph.paths_into(files.filter("module_dir = 'sub'").select("module_dir"))
    assert [tuple(r) for r in into.select("stack", "module_address").collect()] == [("top", "module.a")]
    assert graph.parse_errors.count() == 1
    assert not {"nodes", "edges", "declared"} & set(vars(graph))
    assert graph.edges.filter("to_key = 'sub|var.z'").count() == 1
    assert {r["node_key"] for r in graph.nodes.filter("module_dir = 'sub'").collect()} == {"sub|r.x", "sub|var.z"}


def test_configuration_text_is_spread_at_any_size(spark, tmp_path, monkeypatch):
    schemas = {n: T._SCHEMAS[n] for n in ("nation", "customer", "orders")}
    spark.createDataFrame([(1, "N", 0)], schemas["nation"]).write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "C", 1, 2.0, "S")], schemas["customer"]).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(300).selectExpr(
        "id AS o_orderkey", "1L AS o_custkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice",
        "TIMESTAMP_NTZ '2020-01-01' AS o_orderdate", "'1' AS o_orderpriority")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(T, "_bytes", lambda spark, path: cores * (96 << 20) if "orders" in path else 0)
    files = T.trade_files(spark, str(tmp_path))
    assert files.count() == 303
    assert files.rdd.getNumPartitions() >= cores * 96


def test_references_are_written_once(spark):
    """The resolved references are edges as they lie; only what is derived from them is written beside."""
    files = spark.createDataFrame([
        ("top", "top/main.tf", 'module "a" {\n  source = "../sub"\n  z = local.q\n}\nlocals {\n  q = module.a.o\n}\n'),
        ("sub", "sub/main.tf", 'resource "r" "x" {\n  y = var.z\n}\nvariable "z" {}\noutput "o" {\n  value = r.x.id\n}\n'),
    ], "module_dir string, file string, content string")
    edges = load(files).edges
    kept = {path.split("/")[-2].rsplit("-", 1)[0]: path.rsplit("/", 1)[0] for path in edges.inputFiles()}
    assert set(kept) == {"references", "edges"}
    assert {r["kind"] for r in spark.read.parquet(kept["references"]).select("kind").distinct().collect()} == {"REFERENCES"}
    found = sorted((r["kind"], r["from_key"], r["to_key"]) for r in edges.collect())
    assert found == [("CALLS", "top|module.a", "|source.../sub"), ("INPUTS", "top|module.a", "sub|var.z"), ("REFERENCES", "sub|output.o", "sub|r.x"),
                     ("REFERENCES", "sub|r.x", "sub|var.z"), ("REFERENCES", "top|local.q", "sub|output.o"), ("REFERENCES", "top|local.q", "top|module.a"),
                     ("REFERENCES", "top|module.a", "top|local.q")]
