"""Queries work out what they ask for and nothing else, with the same values."""

import re

import pytest
from pyspark.sql import functions as F

from debtscope.operators import diagnose as D, profile as P
from debtscope.operators.hotspots import function_rows
from debtscope.operators.smells import KEYS, PARTS, smell_rows
from debtscope.plans import advice, update
from debtscope.plans.profile_table import metrics_profile, profile, report_profile
from debtscope.queries import QUERIES
from debtscope.sources import tables

LONG = "def long_one(a):\n" + "    a += 1\n" * 60 + "    return a\n"
TEXTS = {
    "a.py": "import os\n# TODO x\n" + " " * 24 + "x = 12345\n" + LONG + 'p = "/usr/lib"\nprint(p)\n',
    "b.js": "function go(a) {\n" + "  if (a && b) { a--; } else { a++; }\n" * 12 + "}\n// FIXME y\n" + "y" * 130 + "\n",
    "c.go": "func main() {\n\tgo(a)\n}\n",
    "d.md": "# text\n\n// hack\n",
    "e.java": "import a.b;\n" * 20 + "class A {\n" + "\t" * 6 + "x();\n}\n",
    "f.js": "",
}


def rows(df):
    return sorted(map(str, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, "r", p, t) for p, t in TEXTS.items()], "file_id string, repo string, path string, content string")


def test_code_bodies_are_not_shuffled(spark, tmp_path):
    values = [(i // 4, i % 4, i % 7, i % 11) for i in range(96)] * 2 + [(None, 1, 1, 1)]
    spark.createDataFrame(values, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    code = tables.code_files(spark, str(tmp_path))
    assert "BroadcastHashJoin" not in plan(code)
    assert code.filter("content is null or file_id is null").count() == 0


@pytest.mark.parametrize("parts", [(), ("lines",), PARTS])
def test_smells_asked_for(sources, parts):
    texts = sources(TEXTS)
    whole = smell_rows(texts).select("file_id", "detector_no", "key", "count", *parts)
    assert rows(smell_rows(texts, parts=parts).select("file_id", "detector_no", "key", "count", *parts)) == rows(whole)
    for key in KEYS:
        assert rows(smell_rows(texts, (key,), parts).select("file_id", "detector_no", "key", "count", *parts)) == rows(whole.filter(F.col("key") == key))
    assert "TODO" not in plan(smell_rows(texts, ("deep_nesting",), ("lines",)))


def test_functions_asked_for(sources):
    texts = sources(TEXTS)
    for keep_all in (True, False):
        whole = function_rows(texts, keep_all)
        assert rows(function_rows(texts, keep_all, ("name",)).select("file_id", "name", "line", "length")) == rows(whole.select("file_id", "name", "line", "length"))
    assert rows(function_rows(texts, parts=("nesting",)).drop("name")) == rows(function_rows(texts).drop("name"))


def test_metrics_and_problems_asked_for(sources):
    texts = sources(TEXTS)
    whole = P.file_metrics(texts)
    for name in P.METRIC_COLUMNS[3:]:
        assert rows(P.file_metrics(texts, only=("file_id", name))) == rows(whole.select("file_id", name))
    assert "ArrowEvalPython" not in plan(P.file_metrics(texts, only=("file_id", "total")))
    for key, looked_at in D.RULES.items():
        own = D.problem_rows(P.file_metrics(texts, only=("file_id", *looked_at)), (key,)).drop("rank")
        assert rows(own) == rows(D.problem_rows(whole).filter(F.col("key") == key).drop("rank"))


def test_report_profile_decides_as_the_whole_profile(files):
    whole = advice.reported(profile(files))
    for functions in (True, False):
        assert rows(advice.reported(report_profile(files, functions)).select("file_id", "debt_score")) == rows(whole.select("file_id", "debt_score"))
    sections = advice.report_sections(report_profile(files), smells=False)
    assert rows(sections) == rows(advice.report_sections(profile(files)).filter("section <> 3"))


def test_contents_by_metrics_alone(files, tmp_path):
    twice = files.unionByName(files.withColumns({"file_id": F.concat("file_id", F.lit("2")), "path": F.concat(F.lit("v/"), "path")}))
    once = update.profile_contents(twice, str(tmp_path), metrics_profile)
    assert "smells" not in once.columns
    assert rows(once.select("file_id", "debt_score", "path")) == rows(metrics_profile(twice).select("file_id", "debt_score", "path"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Line items that make code files, and texts that come as documents, pages and turns."""
    path = str(tmp_path_factory.mktemp("tables"))
    values = [(i // 4, i % 4, i % 7, i % 11) for i in range(4000)] + [(None, 1, 1, 1)]
    spark.createDataFrame(values, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    texts = [*TEXTS.values(), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, f"<p>{t}</p><script>if (a) {{ b(); }}</script>") for i, t in enumerate(texts)], "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def whole_plan(spark, df):
    """The optimized plan, unabridged; what is worked out first stands last."""
    width = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", width)


def test_only_advised_files_are_described(spark, folder):
    found = QUERIES["snk_06_advice"](spark, folder)
    want = advice.top_file_advice(profile(tables.all_files(spark, folder)))
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.collect()] and found.count() > 20
    told = whole_plan(spark, found)
    assert told.rindex("HACK") < told.rindex("GlobalLimit 10")


def test_only_reported_files_are_described_and_each_pattern_runs_once(spark, folder):
    found = QUERIES["snk_03_advice_report"](spark, folder)
    want = advice.report_sections(profile(tables.all_files(spark, folder)))
    assert rows(found) == rows(want) and found.filter("section = 3").count() > 20
    told = whole_plan(spark, found)
    decided = [m.start() for m in re.finditer(r"debt_score#\d+ >= 5", told)]
    assert told.rindex("HACK") < max(decided) and told.count("HACK") == 1
    assert "class_marked" not in told
