"""Registered queries beside their SQL at the smallest scale; ORACLE_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from oracle.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["explore_documents", "part_scores", "term_df", "refs_by_address", "impact_dependents", "impact_summary",
          "star_orphans", "owning_stacks", "stack_paths", "config_nodes", "config_edges", "config_orphans",
          "overlay_instances", "module_address_split", "excerpt"]
OWN = [q.__name__ for q in entry._QUERIES]
NAMES = OWN if os.environ.get("ORACLE_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    _, rows, difference = compare(spark, connect(FOLDER), entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert not difference
    assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
