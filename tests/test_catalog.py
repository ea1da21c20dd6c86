"""Registered queries against their SQL on the smallest tables.

A spread of queries runs by default; WORDKIN_ALL=1 runs every one.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = [
    "s1_wide_word_list", "s5_comparative_forms", "p10_prune_branches", "j3_candidate_pairs", "a6_word_scores",
    "a22_exact_groups", "e6_dice_round", "m2_alignment_estimate", "j9_ancestor_closure", "a17_clade_support",
    "w2_post_order", "a25_lineage_likelihood", "cluster_job", "b8_cluster_decode", "p8_weight_threshold",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("WORDKIN_ALL") else SOME)
def test_query_equals_sql(spark, con, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
