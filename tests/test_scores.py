"""Scores, labels, diagnosis, rollups and rankings on small metric tables."""

import pytest
from pyspark.sql import functions as F

from debtscope.functions import scores as S, text as X
from debtscope.operators import diagnose as D, ranking as K, rollup as U
from debtscope.plans import summary

BASE = dict(file_id="f", repo="r", path="p", lang="Python", is_logic=True, is_exempt=False, ast_ok=True, total=100, code=80, comments=10,
            boilerplate=10, logic_lines=80, imports=2, max_nesting=0, complexity=5, docstrings=0, debt_score=0, quality_score=90)
SCHEMA = ("file_id string, repo string, path string, lang string, is_logic boolean, is_exempt boolean, ast_ok boolean, total int, code int, "
          "comments int, boilerplate int, logic_lines int, imports int, max_nesting int, complexity int, docstrings int, debt_score int, quality_score int")


@pytest.fixture
def metrics(spark):
    def build(*changes):
        rows = [tuple({**BASE, "path": f"p{i:03d}", "file_id": f"f{i:03d}", **change}.values()) for i, change in enumerate(changes)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


def scored(rows):
    cols = {name: F.col(name) for name in ("is_logic", "logic_lines", "total", "comments")}
    debt = S.debt_score(**cols, imports=F.col("imports"), complexity=F.col("complexity"), max_nesting=F.col("max_nesting"))
    return rows.select(debt.alias("d"), S.quality_score(**cols, complexity=F.col("complexity")).alias("q")).collect()


def test_known_scores(metrics):
    rows = scored(metrics(
        dict(total=429, complexity=97, comments=0),
        dict(total=223, complexity=49, comments=0),
        dict(is_logic=False, logic_lines=4),
        dict(is_logic=False, logic_lines=10, complexity=0, max_nesting=6, imports=0, comments=100, total=600),
        dict(total=0, comments=0, complexity=1, imports=0),
    ))
    assert [r["q"] for r in rows] == [11, 66, -1, 100, 100]
    assert [r["d"] for r in rows] == [142, 65, 0, 14, 0]


def test_one_decimal_rounds_half_even(spark):
    row = spark.range(1).select(*[X.one_decimal(F.lit(v)).alias(str(i)) for i, v in enumerate((9 / 4, 2.35, 1234.56, 0.0))]).first()
    assert list(row) == ["2.2", "2.4", "1234.6", "0.0"]


def test_all_mode_override_can_be_negative(metrics):
    rows = K.displayed(metrics(dict(is_logic=False, logic_lines=0, total=10, max_nesting=0)), show_all=True).collect()
    assert rows[0]["debt_score"] == -39
    assert K.displayed(metrics(dict(is_logic=False, logic_lines=0))).count() == 0


def test_problems_in_order(metrics):
    rows = D.problem_rows(metrics(dict(complexity=30, imports=18, total=400, comments=0, max_nesting=6))).orderBy("rank").collect()
    assert [(r["key"], r["severity"], r["value_text"]) for r in rows] == [
        ("low_comment", 25, "0.0%"), ("long_file", 20, "400"), ("high_complexity", 15, "30"), ("high_nesting", 15, "6"), ("high_coupling", 15, "18"),
    ]
    capped = D.problem_rows(metrics(dict(complexity=500))).first()
    assert capped["severity"] == 100


def test_advice_and_labels(spark):
    rows = spark.createDataFrame([("high_nesting",), ("mystery",)], "key string")
    got = {r["key"]: r for r in D.with_advice(rows, "zh").collect()}
    assert got["high_nesting"]["diagnosis"] == "嵌套层级过深" and len(got["high_nesting"]["suggestions"]) == 2
    assert got["mystery"]["diagnosis"] == "mystery" and got["mystery"]["suggestions"] == []
    keys = spark.createDataFrame([("total",), ("top_files",), ("mystery",)], "key string")
    assert {r["key"]: r["label"] for r in D.with_labels(keys, "zh").collect()} == {
        "total": "合计", "top_files": "🏔️ TOP 10 DEBT FILES (Logic Complexity)", "mystery": "mystery",
    }


def test_rollup_index_and_share(metrics):
    rows = metrics(dict(quality_score=90, code=10), dict(quality_score=51, code=20), dict(quality_score=0, code=99, is_exempt=True),
                   dict(quality_score=-1, code=50, lang="CSS", complexity=0))
    total = {r["lang"]: r for r in U.language_totals(rows).collect()}
    assert total["TOTAL"]["files"] == 4 and total["TOTAL"]["avg_cc"] == "-" and total["CSS"]["avg_cc"] == "-"
    assert total["Python"]["avg_cc"] == "5.0"
    index = U.project_index(rows).first()
    assert (index["project_index"], index["verdict"]) == (64, "shaky")
    assert U.project_index(metrics(dict(quality_score=-1))).count() == 0
    assert U.boilerplate_share(rows).first()["share"] == "10.0"
    assert [r["lang"] for r in summary.language_table(rows, "zh").collect()] == ["Python", "CSS", "合计"]


def test_rankings(metrics):
    rows = metrics(*[dict(debt_score=i % 7) for i in range(30)], dict(debt_score=99, is_exempt=True))
    top = K.top_files(rows).collect()
    assert [r["debt_score"] for r in top] == [6] * 4 + [5] * 4 + [4] * 2
    assert [r["path"] for r in top[:4]] == ["p006", "p013", "p020", "p027"]
    assert [r["debt_score"] for r in K.exempt_files(rows).collect()] == [99]
    assert K.top_files_per_repo(rows, most=3).count() == 3
    shown = summary.ranking_rows(rows).filter("section = 'exempt'").first()
    assert shown["shown_path"].endswith("[Exempt]") and shown["debt_band"] == "fail"


def test_hints_and_bands(spark):
    made = spark.createDataFrame([(21, 60, 5), (20, 51, 5), (20, 50, 5), (20, 50, 4)], "cc int, n int, d int")
    hints = made.select(S.hint_key(F.col("cc"), F.col("n"), F.col("d"))).collect()
    assert [r[0] for r in hints] == ["hint_split", "hint_extract", "hint_guard", None]
    scores = spark.createDataFrame([(v,) for v in (95, 85, 70, 55, 10)], "v int")
    assert [r[0] for r in scores.select(S.verdict_key(F.col("v"))).collect()] == ["legendary", "solid", "average", "shaky", "toxic"]
