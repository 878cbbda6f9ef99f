import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import address as A
from lodestone.operators import instances as I
from lodestone.sources import overlay as O

DOC = "pos int, stack string, source string, content string"


def change(address, module, name, index=None, actions=("no-op",), mode="managed"):
    out = {"address": address, "mode": mode, "type": "berth", "name": name,
           "change": {"actions": list(actions), "before": {"secret": "hunter2"}, "after": None}}
    if module:
        out["module_address"] = module
    if index is not None:
        out["index"] = index
    return out


PLAN = json.dumps({"format_version": "1.2", "terraform_version": "1.7.0", "resource_changes": [
    change("berth.fleet[\"a\"]", None, "fleet", "a"),
    change("berth.fleet[\"b\"]", None, "fleet", "b", ["delete", "create"]),
    change("berth.n[0]", None, "n", 0, ["create", "delete"]),
    change("data.berth.look", None, "look", mode="data", actions=["read"]),
    change("module.dock[\"eu.west\"].module.pier.berth.slot[1]", "module.dock[\"eu.west\"].module.pier", "slot", 1, ["update"]),
    change("module.dock[\"us\"].module.pier.berth.slot[1]", "module.dock[\"us\"].module.pier", "slot", 1, ["update"]),
]})
STATE = json.dumps({"terraform_version": "1.6.0", "values": {"root_module": {
    "resources": [{"address": "berth.one", "mode": "managed", "type": "berth", "name": "one", "values": {"secret": 1}}],
    "child_modules": [{"address": "module.a", "child_modules": [{"address": "module.a.module.b[0]", "resources": [
        {"address": "module.a.module.b[0].berth.deep", "mode": "managed", "type": "berth", "name": "deep"}]}]}]}}})


@pytest.fixture(scope="module")
def built(spark):
    docs = [(0, "live", "p.json", PLAN), (0, "trial", "s.json", STATE), (0, "x", "bad.json", "{nope"),
            (0, "y", "other.json", '{"format_version":"1.0"}'), (0, "z", "list.json", "[]"),
            (0, "e", "empty.json", '{"resource_changes": []}')]
    return O.build(spark.createDataFrame(docs, DOC))


def rows(built, stack):
    return {(r["module_address"], r["config_address"], r["address"]): r for r in built.instances.filter(F.col("stack") == stack).collect()}


def test_kinds_and_versions(built):
    assert built.stacks() == ["live", "trial"]
    assert (built.kind_for("live"), built.kind_for("trial"), built.kind_for("nope")) == ("plan", "state", "none")
    assert (built.terraform_version_for("live"), built.source_for("trial"), built.source_for("nope")) == ("1.7.0", "s.json", "")


def test_broken_files_are_reported_not_fatal(built):
    assert built.is_available() and len(built.partial) == 4
    assert built.unavailable_reason().startswith("4 overlay file(s) could not be read: ")
    assert "bad.json: not a terraform show -json document" in built.partial
    assert "other.json" + O.NEITHER in built.partial
    assert "empty.json" + O.NEITHER in built.partial  # an empty plan is no document either


def test_plan_instances(built):
    got = rows(built, "live")
    assert got["", "berth.fleet", 'berth.fleet["a"]']["index_key"] == "a"
    assert got["", "berth.n", "berth.n[0]"]["index_key"] == "0"
    assert ("", "data.berth.look", "data.berth.look") in got
    assert ("module.dock.module.pier", "berth.slot", 'module.dock["eu.west"].module.pier.berth.slot[1]') in got
    assert got["", "module.dock", 'module.dock["eu.west"]']["index_key"] == "eu.west"
    assert ("module.dock", "module.pier", 'module.dock["us"].module.pier') in got
    assert sum(k[1] == "module.dock" for k in got) == 2


def test_state_instances(built):
    got = rows(built, "trial")
    assert set(got) == {
        ("", "berth.one", "berth.one"), ("module.a.module.b", "berth.deep", "module.a.module.b[0].berth.deep"),
        ("", "module.a", "module.a"), ("module.a", "module.b", "module.a.module.b[0]")}


def test_values_never_become_rows(built):
    assert not [r for r in built.instances.collect() if "hunter2" in str(r)]


def test_action_predicates(spark):
    cases = [([], "", False, False), (["no-op"], "no-op", False, False), (["read"], "read", False, False),
             (["delete", "create"], "replace", True, True), (["create", "delete"], "replace", True, True),
             (["update"], "update", False, True), (["delete", "forget"], "delete+forget", False, True)]
    a = F.col("a")
    df = spark.createDataFrame([(c[0],) for c in cases], "a array<string>")
    got = df.select(I.action_summary(a), I.replaces(a), I.changes(a)).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_module_address_parts(spark):
    cases = [('module.a[0].module.b["x.y"].module.c', ['module.a[0]', 'module.b["x.y"]', "module.c"], "module.a.module.b.module.c"),
             ("", [], ""), ("berth.one", [], ""), ("module.a.berth", ["module.a"], "module.a")]
    df = spark.createDataFrame([(c[0],) for c in cases], "a string")
    got = df.select("a", A.module_segments(F.col("a")), A.normalize_module_address(F.col("a"))).collect()
    assert [tuple(r) for r in got] == cases


def test_explicit_specs():
    assert O.parse_explicit("", ["a"]) == []
    assert O.parse_explicit("p.json", ["a"]) == [("a", "p.json")]
    assert O.parse_explicit(" /x/=p.json , y = q.json,", ["x", "y"]) == [("x", "p.json"), ("y", "q.json")]
    with pytest.raises(O.AmbiguousStackError, match="has 2 roots"):
        O.parse_explicit("p.json", ["a", "b"])


def test_discovery_prefers_plans_and_first_by_name(spark):
    names = [("a", "state.json"), ("a", "plan.json"), ("b", "z.tfplan.json"), ("b", "b.tfplan.json"), ("b", "plan.json"),
             ("c", "tfstate.json"), ("c", "my.tfstate.json"), ("d", "plan.json"), ("e", "tfplan.jsonx")]
    listing = spark.createDataFrame([(d, n, f"{d}/{n}") for d, n in names], "module_dir string, name string, path string")
    roots = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "module_dir string")
    got = {r["stack"]: r["path"] for r in O.discover(listing, roots).collect()}
    assert got == {"a": "a/plan.json", "b": "b/b.tfplan.json", "c": "c/my.tfstate.json"}


def test_instances_are_written_when_asked_for(spark):
    docs = spark.createDataFrame([(0, "live", "p.json", PLAN), (0, "trial", "s.json", STATE)], DOC)
    found = O.build(docs)
    assert found.stacks() == ["live", "trial"] and "instances" not in vars(found)
    assert found.instances.count() == found.instances.count() > 0 and "instances" in vars(found)
