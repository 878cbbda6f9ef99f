"""What the loader and the relationship questions claim, over the tree of telescopes."""

from collections import Counter

from pyspark.sql import functions as F

from lodestone.functions import address as A


def into(edges, key):
    return [e for e in edges if e["to_key"] == key]


def test_mentions_are_not_references(edges):
    """Comments and here-documents name both surveys; only expressions count."""
    found = into(edges, "north|sky_survey.deep")
    assert Counter(e["kind"] for e in found) == {"REFERENCES": 1, "MOVED_FROM": 1}
    assert [e["from_key"] for e in into(edges, "north|sky_survey.wide")] == ["north|sky_survey.deep"]


def test_scopes_do_not_leak(nodes, edges):
    assert "south|sky_survey.deep" in nodes
    assert not into(edges, "south|sky_survey.deep")


def test_hidden_names_count_and_skipped_trees_do_not(nodes):
    assert "south|sky_lens.one" in nodes  # in a file that starts with _
    assert ".night|var.dew" in nodes
    assert not [k for k in nodes if "cached" in k]


def test_dynamic_names_are_bound_by_label(edges):
    """A bare word is no constant, so the name that it gives stays unresolved."""
    assert {e["unresolved"] for e in edges} == {"", "layer.value"}
    assert not [e for e in edges if "bolt" in e["traversal"] or "word" in e["traversal"]]


def test_roots_and_ownership(sky, nodes):
    assert sky.root_dirs == [".night", "examples/dome", "north", "south"]
    mirror, motor = nodes["lib/dome|optic_mirror.primary"], nodes["lib/motor|gear_train.axle"]
    assert (mirror["stack"], mirror["shared"]) == ("", True)
    assert (motor["stack"], motor["shared"]) == ("lib/dome", False)  # only one directory calls it
    assert nodes["north|stack.north"]["name"] == "north"


def test_module_paths(sky):
    paths = {(r["stack"], r["module_address"]) for r in sky.graph.stack_paths.filter("module_dir = 'lib/motor'").collect()}
    assert paths == {("north", "module.east.module.shutter"), ("north", "module.pair.module.shutter"),
                     ("examples/dome", "module.east.module.shutter")}


def test_inputs_and_threaded_outputs(edges):
    place = into(edges, "lib/dome|var.place")
    assert Counter(e["kind"] for e in place) == {"INPUTS": 3, "REFERENCES": 1}
    assert {e["from_key"] for e in into(edges, "lib/motor|output.axle")} == {"lib/dome|optic_mirror.primary", "lib/dome|output.drive"}
    assert [e["from_key"] for e in into(edges, "lib/dome|output.mirror")] == ["north|sky_survey.deep"]


def test_steps_and_depends_on(edges):
    (plate,) = [e for e in into(edges, "north|sky_plate.glass")]
    assert (plate["from_key"], plate["traversal"]) == ("north|sky_survey.deep", "sky_plate.glass[…].path")
    kinds = [e["kind"] for e in into(edges, "lib/dome|module.shutter") if e["from_key"] == "lib/dome|optic_mirror.primary"]
    assert sorted(kinds) == ["DEPENDS_ON", "REFERENCES"]


def test_providers(nodes, edges):
    (edge,) = into(edges, "south|provider.sky.dim")
    assert (edge["kind"], edge["from_key"]) == ("PROVIDES", "south|sky_lens.one")


def test_docs_flags_and_moved(nodes):
    assert nodes["lib/dome|optic_mirror.primary"]["doc"] == "The big glass, ground by hand."  # tabs are trimmed
    assert nodes["lib/dome|var.place"]["doc"] == ""
    assert nodes["north|output.catalogue"]["sensitive"]
    moved = nodes["north|moved.sky_plate.glass"]
    assert (moved["kind"], moved["name"]) == ("moved", "sky_plate.glass")
    assert [k for k, n in nodes.items() if n["deprecated"]] == ["north|sky_plate.glass"]  # it is still declared


def test_sources_are_nodes(nodes):
    versions = {n["version"] for n in nodes.values() if n["kind"] == "module_source" and n["source"] == "stars/almanac"}
    assert versions == {"2.0", "1.4"}
    assert nodes["|source.../lib/dome"]["file"] == "north/sky.tf"


def test_edge_counts(sky):
    counts = {r["kind"]: r["count"] for r in sky.graph.edges.groupBy("kind").count().collect()}
    assert counts["CALLS"] == 6 and counts["PROVIDES"] == counts["MOVED_FROM"] == counts["DEPENDS_ON"] == 1
    assert counts["INPUTS"] == 6 and sky.totals["n_unresolved"] == 1


def test_refs_by_address_name_and_type(sky):
    decls, refs = sky.for_address("sky_survey.deep")
    assert decls.count() == 2
    assert {(r["decl_key"], r["direction"], r["peer_address"]) for r in refs.collect()} == {
        ("north|sky_survey.deep", "referenced_by", peer) for peer in ("output.catalogue", "moved.sky_plate.glass")} | {
        ("north|sky_survey.deep", "references", peer)
        for peer in ("sky_survey.wide", "module.east", "output.mirror", "sky_plate.glass")}
    assert [sky.for_address(q)[0].count() for q in ("wide", "sky_survey", "  ", "nothing.here")] == [1, 3, 0, 0]


def test_impact_both_ways(sky):
    result = sky.impact("local.night")
    assert {r["node_key"]: r["depth"] for r in result.nodes.collect()} == {
        "north|module.east": 1, "north|module.pair": 1, "north|sky_survey.wide": 1, "north|sky_survey.deep": 2,
        "north|output.catalogue": 3, "north|moved.sky_plate.glass": 3}
    assert result.origin.count() == 1
    needs = sky.impact("output.mirror", "dependencies", 10)
    assert {r["address"] for r in needs.nodes.collect()} == {
        "optic_mirror.primary", "module.shutter", "output.axle", "var.coats", "var.place", "gear_train.axle",
        "var.label", "var.speed", "source.../motor"}
    assert not needs.truncated


def test_via_is_the_first_edge(sky):
    rows = {r["node_key"]: r["via"] for r in sky.impact("local.night", depth=1).nodes.collect()}
    assert rows["north|module.pair"]["traversal"] == "local.night[…]"


def test_orphans(sky):
    assert {r["node_key"]: r["reason"] for r in sky.orphans().collect()} == {
        "lib/dome|var.spare": "declared but never referenced",
        "lib/dome|output.drive": "exported by a child module but consumed by no caller",
    }


def test_module_skew_first(sky):
    rows = [(r["source"], r["n_versions"], r["n_sites"], r["local"]) for r in sky.modules().collect()]
    assert rows == [("stars/almanac", 2, 2, False), ("../../lib/dome", 1, 1, True), ("../lib/dome", 1, 2, True), ("../motor", 1, 1, True)]
    assert [r["source"] for r in sky.modules("STARS").collect()] == ["stars/almanac"]
    assert sky.modules("%").count() == 0  # not a pattern


def test_explicit_misses(sky):
    for query in ("postgres replication lag", "annual tax return", "qqqq xxxx"):
        assert sky.explore(query).hits.count() == 0


def test_exact_address_first_and_question_finds_its_subject(sky):
    hits = [r["node_key"] for r in sky.explore("sky_survey.deep").hits.collect()]
    assert set(hits[:2]) == {"north|sky_survey.deep", "south|sky_survey.deep"}
    assert sky.explore("which survey needs tracking of quasars").hits.first()["node_key"] == "north|sky_survey.wide"


def test_each_declaration_of_a_key_is_one_hit(sky):
    hits = [(r["node_key"], r["file"]) for r in sky.explore("var.hour", max_nodes=2).hits.collect()]
    assert sorted(hits) == [("south|var.hour", "south/_lens.tf"), ("south|var.hour", "south/again.tf")]


def test_example_is_demoted(sky):
    scores = {r["node_key"]: r["score"] for r in sky.explore("dome east", max_nodes=25).hits.collect()}
    assert scores["examples/dome|module.east"] < scores["north|module.east"]


def test_sql_views(spark, sky):
    sky.views("t_")
    n = spark.sql("SELECT count(*) FROM t_edges e LEFT SEMI JOIN t_nodes n ON e.to_key = n.node_key").first()[0]
    assert n == sky.totals["n_edges"] - sky.totals["n_unresolved"]


def test_traversal_addresses(spark):
    cases = [
        ("var.zone", "var.zone", "provider.var.zone", "var.zone"),
        ('local.c["k.x"].y', "local.c", "provider.local.c", "local.c[…].y"),
        ("data.a.b.c", "data.a.b", "provider.data.a", "data.a.b.c"),
        ("data.a", None, "provider.data.a", "data.a"),
        ("cloud", None, "provider.cloud", "cloud"),
        ("mq[0].x", None, "provider.mq", "mq[…].x"),
        ("mq.web.0.id", "mq.web", "provider.mq.web", "mq.web[…].id"),
    ]
    rows = spark.createDataFrame([(c[0],) for c in cases], "raw string").select(
        "raw", A.traversal_address(F.col("raw")), A.provider_address(F.col("raw")), A.traversal_text(F.col("raw"))).collect()
    assert [tuple(r) for r in rows] == cases


def test_local_targets(spark):
    cases = [("a/b", "../c", "a/c"), ("", "./x/", "x"), ("a", "../", ""), ("a", "../../x", None), ("a", "x/y", None),
             ("a/b", "./../d/./e/../f", "a/d/f")]
    rows = spark.createDataFrame([c[:2] for c in cases], "d string, s string").select(
        A.local_target(F.col("d"), F.col("s"))).collect()
    assert [r[0] for r in rows] == [c[2] for c in cases]


def test_plain_traversals_are_taken_apart_as_by_patterns(spark):
    raws = ["var.zone", "data.a.b.c", "data.a.b", "data.a", "data", "cloud", "a-b.c_d.e9", "_x.y", "é.b", "a.é", "a.b.0", "a . b", "a[0].b",
            "a.b[\"c.d\"]", "a.b\n", "a..b", "a.", "data . a.b", "data.a[0].b"]
    rows = spark.createDataFrame([(r,) for r in raws], "raw string")
    raw, plain, never = F.col("raw"), A.is_plain(F.col("raw")), F.lit(False)
    for part in (A.traversal_root, A.traversal_address, A.provider_address, A.traversal_text):
        got = rows.select("raw", part(raw, plain).alias("fast"), part(raw, never).alias("slow"), plain.alias("plain")).collect()
        assert [(r["raw"], r["fast"]) for r in got] == [(r["raw"], r["slow"]) for r in got]
    assert [r["raw"] for r in got if r["plain"]] == raws[:8]
