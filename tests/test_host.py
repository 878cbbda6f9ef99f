"""A host over a tree that changes, reports with an overlay, and the command line."""

import json
import os
from collections import Counter
from pathlib import Path

import pytest

from lodestone import cli
from lodestone.operators.modules import UNPINNED
from lodestone.plans import report
from lodestone.streaming.host import Host
from lodestone.tools import Tools
from tests.conftest import write_tree

FLEET = {
    "main.tf": '''
variable "names" { type = set(string) }
resource "berth" "ship" {
  for_each = var.names
}
resource "berth" "tug" {
  from = berth.ship["a"].id
}
module "yard" {
  source   = "./yard"
  for_each = toset(["n", "s"])
  seed     = berth.tug.id
}
''',
    "yard/main.tf": '''
variable "seed" {}
resource "berth" "crane" {
  count = 2
  seed  = var.seed
}
''',
}


def plan(tug=("update",)):
    def change(address, name, module=None, actions=("no-op",)):
        return {"address": address, "module_address": module or "", "mode": "managed", "type": "berth", "name": name,
                "change": {"actions": list(actions)}}
    return json.dumps({"terraform_version": "1.7", "resource_changes": [
        *[change(f'berth.ship["{k}"]', "ship") for k in "abc"], change("berth.tug", "tug", actions=tug),
        *[change(f'module.yard["{k}"].berth.crane[{i}]', "crane", f'module.yard["{k}"]', ("create",)) for k in "ns" for i in (0, 1)],
    ]})


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet")
    write_tree(root, {**FLEET, "plan.json": plan(("delete", "create"))})
    host = Host(spark, str(root))
    return root, host, host.current()


def test_instances_of_expanded_blocks(fleet):
    _, _, ix = fleet
    counts = {r["node_key"]: r["count"] for r in ix.instances.groupBy("node_key").count().collect()}
    assert counts == {"|berth.ship": 3, "|berth.tug": 1, "|module.yard": 2, "yard|berth.crane": 4}


def test_impact_names_what_a_plan_replaces(fleet):
    _, _, ix = fleet
    text = report.impact_text(ix, "berth.tug")
    assert "DESTROYED AND RECREATED by this plan (1):\n  berth.tug\n" in text
    assert "Resolved against a plan: 3 real instance(s)" in text
    assert "(2 instances)" in text


def test_answers_carry_their_instances(fleet):
    _, _, ix = fleet
    touched = ix.impact("berth.tug")
    # The origin counts, and so does what the module it feeds into is called by.
    assert touched.overlay_available
    assert {r["address"] for r in touched.instances.filter("node_key = '|berth.tug'").collect()} == {"berth.tug"}
    assert touched.instances.filter("node_key = '|module.yard'").count() == 2
    assert [r["address"] for r in ix.explore("berth.tug", 1).instances.collect()] == ["berth.tug"]
    assert [(r["source"], r["version"], r["n_sites"]) for r in ix.module_versions().collect()] == [("./yard", UNPINNED, 1)]
    assert [(r["source"], r["address"], r["module_dir"]) for r in ix.module_sites("yard").collect()] == [("./yard", "module.yard", "")]
    assert ix.module_sites("nothing").isEmpty()


def test_explore_lists_instances(fleet):
    text = report.explore_text(fleet[2], "berth.tug", 1)
    assert "instances in .: 1   planned: replace\n  berth.tug\n" in text


def test_two_clocks(fleet):
    root, host, first = fleet
    assert host.current() is first and (host.builds, host.overlay_builds) == (1, 1)
    (root / "plan.json").write_text(plan())
    second = host.current()
    assert second is not first and (host.builds, host.overlay_builds) == (1, 2)
    assert second.graph is first.graph and second.postings is first.postings
    assert "Nothing in this set is replaced" in report.impact_text(second, "berth.tug")
    (root / "plan.json").write_text("{broken")
    third = host.current()
    assert not third.overlay.is_available() and "not a terraform show -json document" in third.unavailable_reason()
    assert third.instances is None


def test_status_explains_a_bad_overlay_and_a_parse_error(spark, tmp_path):
    write_tree(tmp_path, {"a/main.tf": 'variable "x" {\n  oops\n}\noutput "y" { value = remote.thing.z }\n', "b/main.tf": "", "b/plan.json": "[]"})
    host = Host(spark, str(tmp_path))
    tools = Tools(host)
    text = tools.terra_status()
    assert f"plan overlay: not loaded — {tmp_path}/b/plan.json: not a terraform show -json document." in text
    assert "parse errors (1):\n  a/main.tf: line 2" in text
    assert "unresolved references: 1 of 1" in text
    host.with_plan("one.json")
    host.current()
    assert "has 2 roots (a, b)" in str(host.explicit_plan_error())
    os.remove(tmp_path / "b" / "main.tf")
    host.with_plan("a=" + str(tmp_path / "none.json"))
    index = host.current()
    assert index.root_dirs == ["a"] and host.builds == 2
    assert "No such file" in index.unavailable_reason()
    assert host.explicit_plan_error() is None


def test_reports_state_totals_and_fit(sky):
    full = report.for_address_text(sky, "sky_survey")
    assert full.startswith('3 declaration(s) of "sky_survey".') and "referenced by (2):" in full
    assert "  moved.sky_plate.glass" in full and "[MOVED_FROM]  as sky_plate.glass → sky_survey.deep" in full
    small = report.for_address_text(sky, "sky_survey", 500)
    assert "omitted for space" in small and small.startswith("3 declaration(s)")
    small = report.orphans_text(sky, 150)
    assert small.startswith("2 unreferenced declaration(s).") and "[1 orphan(s) omitted for space" in small
    small = report.modules_text(sky, "", 300)
    assert small.startswith("4 module source(s); 1 pinned") and "[3 module source(s) omitted" in small
    small = report.impact_text(sky, "local.night", "dependents", 2, 300)
    assert "omitted for space" in small and "Truncated at depth 2" in small
    for text in (report.for_address_text(sky, "sky_survey", 1000), report.impact_text(sky, "local.night", char_budget=1000),
                 report.modules_text(sky, "", 1000), report.orphans_text(sky, 1000),
                 report.explore_text(sky, "sky", 5, 1000)):
        assert len(text) <= 4000


def test_reports_say_when_there_is_nothing(sky):
    assert report.explore_text(sky, "zebra").startswith('No configuration scored above the relevance threshold for "zebra".')
    assert report.explore_text(sky, " ").startswith("No configuration scored")
    assert report.for_address_text(sky, "no.such").startswith('Nothing in this repository declares "no.such".')
    assert report.impact_text(sky, "no.such").startswith('Nothing in this repository declares "no.such", so')
    assert "Nothing reaches it" in report.impact_text(sky, "var.spare")
    assert report.modules_text(sky, "nope") == 'No module source or call name matches "nope".'
    static = report.impact_text(sky, "local.night", "dependents", 1)
    assert "This is what is *connected*" in static


def test_command_line(spark, sky_root, capsys):
    assert cli.main([]) == 2 and "usage:" in capsys.readouterr().err
    assert cli.main(["frobnicate"]) == 2 and 'unknown command "frobnicate"' in capsys.readouterr().err
    assert cli.main(["help"]) == 0 and "usage:" in capsys.readouterr().out
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.startswith("lodestone ")
    assert cli.main(["status", "--repo", "/no/such/dir"]) == 1
    capsys.readouterr()
    # Flags may follow the words.
    assert cli.main(["impact", "local.night", "--repo", sky_root, "--depth", "1", "--plan", "p.json"], spark) == 0
    out = capsys.readouterr()
    assert "(depth 1)" in out.out and "--plan ignored: cannot tell which root module 'p.json'" in out.err


def test_listing_matches_the_tree(spark, tmp_path):
    from lodestone.sources import tree
    files = {f"d{i}/e{j}/f.tf": "" for i in range(4) for j in range(3)}
    write_tree(tmp_path, {**files, "_h.tf": "", ".git/x.tf": "", "v/x.auto.tfvars": "", "w/y.tfvars.json": "{}"})
    os.symlink(tmp_path / "d0", tmp_path / "loop")
    with tree.listing(spark, str(tmp_path)) as listed:
        assert {r["file"] for r in tree.configuration(listed).collect()} == set(files) | {"_h.tf"}
        assert {r["module_dir"] for r in tree.variable_dirs(listed).collect()} == {"v", "w"}
        assert listed.count() == 16  # the link counts as a file and is not followed


def test_superseded_snapshots_go_when_nobody_holds_them(spark, tmp_path):
    def tables():
        kept = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        return {p.name for p in kept.iterdir() if (p / "_SUCCESS").exists()}

    before = tables()
    write_tree(tmp_path, {"main.tf": 'variable "a" {}\nresource "berth" "tug" { from = var.a }\n', "plan.json": plan()})
    host = Host(spark, str(tmp_path))

    def ask():
        index = host.current()
        assert index.instances.count() == 1 and index.graph.keyed
        return index

    held = ask()
    first = tables() - before
    write_tree(tmp_path, {"more.tf": 'variable "b" {}\n'})
    ask()  # nobody keeps this one
    assert first <= tables() and held.graph.nodes.filter("kind = 'variable'").count() == 1
    held = None
    write_tree(tmp_path, {"last.tf": 'variable "z" {}\n'})
    ask()
    left = tables() - before
    assert not left & first and host.builds == 3
    assert Counter(n.rpartition("-")[0] for n in left) == Counter(n.rpartition("-")[0] for n in first)
    host.close()
    assert not tables() - before
