"""Display filter, override and top-k over file metrics.

Ties are broken by repository and path, so every ranking is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from debtscope.functions import scores as S

TOP_FILES = 10
ADVISED_FILES = 5
EXEMPT_DEBT = 20


def by_debt() -> list:
    return [F.col("debt_score").desc(), F.col("repo"), F.col("path")]


def with_override(metrics: DataFrame, show_all: bool) -> DataFrame:
    """In all-mode, unscored files rank by size and depth; the value may be negative."""
    if not show_all:
        return metrics
    debt = S.all_mode_debt(*map(F.col, ("is_logic", "logic_lines", "total", "max_nesting", "debt_score")))
    return metrics.withColumn("debt_score", debt)


def displayed(metrics: DataFrame, show_all: bool = False) -> DataFrame:
    """Files the ranking shows: scored ones, or all of them in all-mode."""
    if show_all:
        return with_override(metrics, True)
    return metrics.filter(S.is_scored(F.col("is_logic"), F.col("logic_lines")))


def top_files(metrics: DataFrame, show_all: bool = False, most: int = TOP_FILES) -> DataFrame:
    """The files with most debt, exempt ones aside."""
    return displayed(metrics, show_all).filter(~F.col("is_exempt")).orderBy(*by_debt()).limit(most)


def top_files_per_repo(metrics: DataFrame, show_all: bool = False, most: int = TOP_FILES) -> DataFrame:
    """``top_files`` within each repository; Spark limits each map task before the shuffle."""
    ranked = displayed(metrics, show_all).filter(~F.col("is_exempt"))
    rank = F.row_number().over(W.partitionBy("repo").orderBy(F.col("debt_score").desc(), "path"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= most)


def exempt_files(metrics: DataFrame, show_all: bool = False) -> DataFrame:
    """Exempt files with more debt than the display limit, most debt first."""
    return displayed(metrics, show_all).filter(F.col("is_exempt") & (F.col("debt_score") > EXEMPT_DEBT)).orderBy(*by_debt())


def with_display(metrics: DataFrame) -> DataFrame:
    """Labels and bands of a ranking row."""
    cc, depth, ok = F.col("complexity"), F.col("max_nesting"), F.col("ast_ok")
    tagged = ~F.col("is_logic") & (F.col("logic_lines") >= 5)
    return metrics.withColumns(
        {
            "complexity_label": S.complexity_label(cc, depth, ok),
            "quality_text": S.quality_text(F.col("quality_score")),
            "debt_band": S.debt_band(F.col("debt_score")),
            "quality_band": S.quality_band(F.col("quality_score")),
            "shown_path": F.concat("path", F.when(tagged, " [JavaScript]").otherwise("")),
        }
    )
