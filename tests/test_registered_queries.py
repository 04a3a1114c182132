"""Registered queries against their oracles on the smallest tables."""

import pytest

import __spark_entry__ as entry
from debtscope.queries import QUERIES
from oracles.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLED = [
    "src_01_directory_tree", "src_04_decoded_text", "src_06_syntax_nodes", "sml_02_magic_number", "sml_04_duplicate_string", "snk_03_advice_report",
    "snk_06_advice", "win_02_segmented_counts", "prj_10_line_complexity", "prj_12_import_lines", "win_02_comment_state", "set_01_all_smells",
    "dia_02_high_nesting", "fn_02_function_names", "win_05_braced_end", "agg_10_grand_total", "agg_15_deep_nesting_places", "fn_04_function_complexity", "set_02_all_problems", "snk_05_ranking",
]


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLED)
def test_query_equals_oracle(spark, oracle, name):
    count, problem = compare(entry.queries()[name](spark, SF_DIR), oracle, entry.oracle_sql()[name])
    assert count > 0 and problem == ""


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and [r["debt_score"] for r in rows] == sorted((r["debt_score"] for r in rows), reverse=True)
