"""Threshold diagnosis of file metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from debtscope import dims
from debtscope.functions import text as X
from debtscope.functions.stage import staged


def _problem(number: int, key: str, fires: Column, severity: Column, value: Column, text: Column) -> Column:
    return F.when(
        fires,
        F.struct(
            F.lit(number).alias("rule_no"),
            F.lit(key).alias("key"),
            F.least(F.lit(100), severity.cast("int")).alias("severity"),
            value.cast("double").alias("value"),
            text.alias("value_text"),
        ),
    )


#: The measures that each rule looks at, in rule order.
RULES = {
    "high_complexity": ("complexity",),
    "high_nesting": ("max_nesting",),
    "high_coupling": ("imports",),
    "long_file": ("total",),
    "low_comment": ("total", "comments"),
}


def problems(keys: Sequence[str] = tuple(RULES)) -> Column:
    """Problems of one metrics row by the rules in ``keys``, most severe first, ties in rule order."""
    cc, depth, imports, total = F.col("complexity"), F.col("max_nesting"), F.col("imports"), F.col("total")
    ratio = F.when(total > 0, F.col("comments") / total).otherwise(0.0)
    percent = ratio * 100
    counted = [
        (1, "high_complexity", cc > dims.HIGH_COMPLEXITY, (cc - dims.HIGH_COMPLEXITY) * 3, cc),
        (2, "high_nesting", depth > dims.HIGH_NESTING, (depth - dims.HIGH_NESTING) * 15, depth),
        (3, "high_coupling", imports > dims.HIGH_COUPLING, (imports - dims.HIGH_COUPLING) * 5, imports),
        (4, "long_file", total > dims.LONG_FILE, (total - dims.LONG_FILE) / 5, total),
    ]
    found = [_problem(*rule, rule[-1].cast("string")) for rule in counted if rule[1] in keys]
    if "low_comment" in keys:
        found.append(
            _problem(
                5,
                "low_comment",
                (ratio < dims.LOW_COMMENT_RATIO) & (total > 50),
                (F.lit(dims.LOW_COMMENT_RATIO) - ratio) * 500,
                percent,
                F.concat(X.one_decimal(percent), F.lit("%")),
            )
        )
    ordered = F.array_sort(
        F.transform(
            F.array_compact(F.array(*found)),
            lambda p: F.struct((-p["severity"]).alias("order"), p["rule_no"].alias("rule_no"), p.alias("problem")),
        )
    )
    return F.transform(ordered, lambda x: x["problem"])


def with_problems(metrics: DataFrame) -> DataFrame:
    return staged(metrics, metrics.columns, problems=problems())


def problem_rows(metrics: DataFrame, keys: Sequence[str] = tuple(RULES)) -> DataFrame:
    """``file_id, rank, rule_no, key, severity, value, value_text`` by the rules in ``keys``."""
    rows = metrics.select("file_id", F.posexplode(problems(keys)).alias("pos", "p"))
    return rows.select("file_id", (F.col("pos") + 1).alias("rank"), "p.*")


def with_advice(problem: DataFrame, locale: str = "en", most: int = 2) -> DataFrame:
    """Join diagnosis and the first suggestions, in English for an unknown locale; an unknown key shows as itself."""
    texts = dims.advice(problem.sparkSession).filter(F.col("locale") == dims.spoken(locale)).drop("locale")
    joined = problem.join(F.broadcast(texts), "key", "left")
    return joined.withColumns(
        {
            "diagnosis": F.coalesce("diagnosis", "key"),
            "suggestions": F.slice(F.coalesce("suggestions", F.array().cast("array<string>")), 1, most),
        }
    )


def with_labels(rows: DataFrame, locale: str, key: str = "key") -> DataFrame:
    """Add ``label``: the text in ``locale``, else in English, else the key."""
    texts = dims.labels(rows.sparkSession)
    own = texts.filter(F.col("locale") == locale).select(F.col("key").alias(key), F.col("text").alias("own_text"))
    english = texts.filter(F.col("locale") == "en").select(F.col("key").alias(key), F.col("text").alias("english_text"))
    joined = rows.join(F.broadcast(own), key, "left").join(F.broadcast(english), key, "left")
    return joined.withColumn("label", F.coalesce("own_text", "english_text", F.col(key))).drop("own_text", "english_text")
