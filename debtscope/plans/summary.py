"""Summary and ranking views of a metrics or profile table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from debtscope.operators import ranking, rollup
from debtscope.operators.diagnose import with_labels


def language_table(metrics: DataFrame, locale: str = "en") -> DataFrame:
    """Languages by code lines, the total row last; ``row_no`` is the display order."""
    rows = rollup.language_totals(metrics).withColumn("key", F.when(F.col("is_total"), "total").otherwise(F.col("lang")))
    labelled = with_labels(rows, locale).withColumn("lang", F.col("label")).drop("key", "label")
    return labelled.orderBy("is_total", F.col("code").desc(), "lang")


def verdict(metrics: DataFrame, locale: str = "en", *by: str) -> DataFrame:
    """Index, verdict label, total lines and boilerplate share."""
    index = rollup.project_index(metrics, *by)
    return with_labels(index, locale, "verdict").withColumnRenamed("label", "verdict_text")


def ranking_rows(metrics: DataFrame, show_all: bool = False, most: int = ranking.TOP_FILES) -> DataFrame:
    """Top files and then exempt files, each by debt, with labels and bands."""
    top = ranking.top_files(metrics, show_all, most).withColumn("section", F.lit("top"))
    exempt = ranking.exempt_files(metrics, show_all).withColumn("section", F.lit("exempt"))
    both = ranking.with_display(top.unionByName(exempt))
    suffix = F.when(F.col("section") == "exempt", F.concat("path", F.lit(" [Exempt]"))).otherwise(F.col("shown_path"))
    ordered = both.withColumn("shown_path", suffix).orderBy(F.col("section") == "exempt", *ranking.by_debt())
    return ordered.select(
        "section", "debt_score", "quality_text", "complexity_label", "imports", "total", "shown_path", "debt_band",
        "quality_band", "repo", "path",
    )
