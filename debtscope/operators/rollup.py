"""Rollups over file metrics; every aggregate combines map-side before its narrow shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from debtscope.functions import scores as S, text as X

_SUMS = {"total": "total", "code": "code", "comments": "comments", "boilerplate": "boilerplate", "imports": "imports",
         "cc": "complexity"}


def _sums() -> list[Column]:
    return [F.count("*").alias("files"), *[F.sum(src).alias(name) for name, src in _SUMS.items()]]


def average_complexity(cc: Column, files: Column) -> Column:
    """One decimal, or a dash where there is none."""
    return F.when((files > 0) & (cc > 0), X.one_decimal(cc / files)).otherwise("-")


def language_rollup(metrics: DataFrame) -> DataFrame:
    """One row per language."""
    rows = metrics.groupBy("lang").agg(*_sums())
    return rows.withColumn("avg_cc", average_complexity(F.col("cc"), F.col("files")))


def language_totals(metrics: DataFrame, total_label: str = "TOTAL") -> DataFrame:
    """Languages plus the grand total, which has no average."""
    rows = metrics.rollup("lang").agg(*_sums(), F.grouping("lang").alias("is_total"))
    average = F.when(F.col("is_total") == 1, "-").otherwise(average_complexity(F.col("cc"), F.col("files")))
    label = F.when(F.col("is_total") == 1, total_label).otherwise(F.col("lang"))
    return rows.withColumns({"lang": label, "avg_cc": average, "is_total": F.col("is_total").cast("boolean")})


def in_index() -> Column:
    """Files that count towards the index: scored and not exempt."""
    return (F.col("quality_score") >= 0) & ~F.col("is_exempt")


def project_index(metrics: DataFrame, *by: str) -> DataFrame:
    """Code-weighted mean quality with its verdict; no row where no code counts."""
    weight = F.when(in_index(), F.col("code")).otherwise(0).cast("long")
    rows = metrics.groupBy(*by).agg(
        F.sum(weight * F.col("quality_score")).alias("weighted"), F.sum(weight).alias("weight")
    )
    index = F.floor(F.col("weighted") / F.col("weight")).cast("int")
    scored = rows.filter(F.col("weight") > 0).withColumn("project_index", index)
    return scored.withColumn("verdict", S.verdict_key(F.col("project_index")))


def boilerplate_share(metrics: DataFrame) -> DataFrame:
    """Boilerplate lines in percent of all lines, one decimal."""
    rows = metrics.agg(F.sum("total").alias("total"), F.sum("boilerplate").alias("boilerplate"))
    share = F.when(F.col("total") > 0, X.one_decimal(F.col("boilerplate") / F.col("total") * 100))
    return rows.withColumn("share", share)
