"""Plan shapes the engine relies on at scale."""

import pytest
from pyspark.sql import functions as F

from debtscope.operators import profile as P, ranking as K
from debtscope.operators.hotspots import function_rows
from debtscope.operators.smells import smell_rows
from debtscope.plans.profile_table import profile
from debtscope.sources.corpus import source_files


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "files")
    rows = [(i, "r", f"src/f{i}.{ext}", "if a:\n    b\n") for i, ext in enumerate(["py", "js", "go", "html"] * 5)]
    spark.createDataFrame(rows, "file_id long, repo string, path string, content string").write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_is_map_only(corpus):
    text = plan(profile(corpus))
    assert text.count("Exchange") == text.count("BroadcastExchange") == 1
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_syntax_trees_are_built_once(corpus):
    assert plan(profile(corpus)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("rows", [smell_rows, function_rows])
def test_detail_relations_are_map_only(corpus, rows):
    assert plan(rows(source_files(corpus))).count("Exchange") == 1


def test_filters_on_metrics_do_not_repeat_the_scan_work(corpus):
    text = plan(P.file_metrics(source_files(corpus)).filter("complexity > 3"))
    assert text.count("ArrowEvalPython") == 1
    filters = [line for line in text.splitlines() if "Filter" in line]
    assert not any("regexp" in line for line in filters)


def test_scan_reads_only_needed_columns(corpus):
    text = plan(corpus.withColumn("unused", F.lit(1)).transform(source_files).select("file_id", "lang"))
    assert "ReadSchema: struct<file_id:bigint,path:string>" in text


def test_rollup_shuffles_partial_sums_only(corpus):
    text = plan(P.file_metrics(source_files(corpus)).groupBy("lang").agg(F.sum("total")))
    assert "partial_sum" in text and "Exchange hashpartitioning(lang" in text


def test_top_files_per_repo_limits_before_the_shuffle(corpus):
    text = plan(K.top_files_per_repo(P.file_metrics(source_files(corpus))))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_top_files_never_sort_globally(corpus):
    assert "TakeOrderedAndProject" in plan(K.top_files(P.file_metrics(source_files(corpus))))
