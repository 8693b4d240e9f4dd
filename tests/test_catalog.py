"""Registered queries against their SQL on the small tables, whole results."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

QUICK = [
    "s2_stack_sources", "s4_assign_row_id", "p3_finite", "p10_row_pixels", "p14_label_from_text", "a4_feature_characteristics", "a5_extra_characteristics",
    "a11_column_histograms", "a17_tree_shape", "a18_leaf_purity", "k11_child_labels", "v4_homogeneity", "v8_merge_count", "t15_table_diff", "t24_non_dominated", "b7_greedy_matches",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, name):
    result = compare(spark, connect(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert result.startswith("ok"), result


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
