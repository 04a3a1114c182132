"""Report sinks: CSV, file table and per-file advice.

Reports are written in global order by range-partitioned sorts, one output file per
partition; nothing is gathered on the driver or in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from debtscope import dims
from debtscope.functions import scores as S
from debtscope.operators import ranking
from debtscope.plans.advice import KEYS, report_sections

CSV_KEYS = ["file_path", "language", "debt_score", "quality_score", "complexity", "Type", "lines", "code", "comments", "imports"]
TABLE_KEYS = ["file_path", "language", "debt_score", "quality_score", "complexity", "lines", "imports"]


def _label(key: str, locale: str) -> str:
    texts = {(k, loc): text for k, loc, text in dims.label_rows()}
    return texts.get((key, locale), texts.get((key, "en"), key))


def csv_rows(metrics: DataFrame) -> DataFrame:
    """The ten report columns of every file, plus ``repo`` to order by."""
    cc, depth = F.col("complexity"), F.col("max_nesting")
    return metrics.select(
        "repo",
        F.col("path").alias("file_path"),
        F.col("lang").alias("language"),
        "debt_score",
        S.quality_text(F.col("quality_score")).alias("quality_score"),
        S.complexity_value(cc, depth).alias("complexity"),
        S.complexity_type(cc, F.col("ast_ok")).alias("Type"),
        F.col("total").alias("lines"),
        "code",
        "comments",
        "imports",
    )


def csv_lines(metrics: DataFrame, locale: str = "en", show_all: bool = False) -> DataFrame:
    """The lines of the CSV report in order: the localized heading, then all files by debt."""
    rows = csv_rows(ranking.with_override(metrics, show_all))
    line = F.to_csv(F.struct(*CSV_KEYS), {"escape": '"', "quote": '"'})
    heading = dims.local_table(metrics.sparkSession, [(0, 0, "", "", ",".join(_label(key, locale) for key in CSV_KEYS))],
                               "chapter int, debt_score int, repo string, file_path string, line string")
    lines = heading.unionByName(rows.select(F.lit(1).alias("chapter"), "debt_score", "repo", "file_path", line.alias("line")))
    return lines.orderBy("chapter", F.col("debt_score").desc(), "repo", "file_path")


def write_csv(metrics: DataFrame, path: str, locale: str = "en", show_all: bool = False) -> None:
    """The CSV report as ordered part files, of which only the first has the heading: one after the other they are one file."""
    csv_lines(metrics, locale, show_all).select("line").write.mode("overwrite").text(path)


def _cells(*cells) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def table_lines(metrics: DataFrame) -> DataFrame:
    """One table line per file with its sort keys."""
    text = lambda name: F.col(name).cast("string")
    line = _cells(
        F.concat(F.lit("`"), F.col("path"), F.lit("`")),
        F.col("lang"),
        text("debt_score"),
        S.quality_text(F.col("quality_score")),
        S.complexity_cell(F.col("complexity"), F.col("max_nesting")),
        text("total"),
        text("imports"),
    )
    return metrics.select(*KEYS, line.alias("line"))


def report_lines(profile: DataFrame, locale: str = "en", include_advice: bool = False, show_all: bool = False) -> DataFrame:
    """Every report line with the keys that order it: ``chapter, debt_score, repo, path, section, item, part``."""
    spark = profile.sparkSession
    shown = ranking.with_override(profile, show_all)
    title = [f"# {_label('code_quality_report', locale)}", "", _label("generated_by", locale), "",
             f"## {_label('file_analysis', locale)}", "",
             "| " + " | ".join(_label(k, locale) for k in TABLE_KEYS) + " |", "| --- | --- |" + " ---: |" * 5]
    advice_title = ["", "---", "", f"## {_label('refactor_advisor', locale)}", ""]
    schema = "chapter int, debt_score int, repo string, path string, section int, item int, part int, line string"

    def fixed(chapter: int, texts: list[str]) -> DataFrame:
        return dims.local_table(spark, [(chapter, 0, "", "", 0, 0, i, text) for i, text in enumerate(texts)], schema)

    zero = F.lit(0)
    rows = table_lines(shown).select(F.lit(1).alias("chapter"), *KEYS, zero.alias("section"), zero.alias("item"), zero.alias("part"), "line")
    lines = fixed(0, title).unionByName(rows)
    if include_advice:
        sections = report_sections(shown, locale).withColumn("chapter", F.lit(3))
        lines = lines.unionByName(fixed(2, advice_title)).unionByName(sections)
    return lines.orderBy("chapter", F.col("debt_score").desc(), "repo", "path", "section", "item", "part")


def write_report(profile: DataFrame, path: str, locale: str = "en", include_advice: bool = False, show_all: bool = False) -> None:
    """Write the report as ordered text files."""
    report_lines(profile, locale, include_advice, show_all).select("line").write.mode("overwrite").text(path)


def export(profile: DataFrame, path: str, **options) -> None:
    """CSV for a ``.csv`` path, else the text report."""
    if path.endswith(".csv"):
        options.pop("include_advice", None)
        write_csv(profile, path, **options)
    else:
        write_report(profile, path, **options)
