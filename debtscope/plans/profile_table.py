"""The profile table: everything the reports need, written once per corpus.

One map-only pass reads the texts and writes one narrow row per file.  All rollups, rankings
and reports read this table, so texts are scanned once however many reports follow, and a
lost executor costs no more than its own unfinished scan tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from debtscope.operators import hotspots, ranking
from debtscope.operators.diagnose import with_problems
from debtscope.operators.hotspots import with_classes, with_functions
from debtscope.operators.profile import file_metrics
from debtscope.operators.smells import with_smells
from debtscope.sources.corpus import source_files


def profile(files: DataFrame, *carry: str) -> DataFrame:
    """Metrics, problems, smells, hotspot functions and classes, one row per file; ``carry`` names further columns to keep."""
    described = with_classes(with_functions(with_smells(source_files(files))))
    return with_problems(file_metrics(described, carry=["smells", "functions", "classes", *carry]))


def metrics_profile(files: DataFrame, *carry: str) -> DataFrame:
    """The metrics alone, where neither smells nor functions are asked for."""
    return file_metrics(source_files(files), carry=list(carry))


def _measured(files: DataFrame) -> DataFrame:
    """Metrics and problems with the texts still beside them, so that only files that stay are looked into further."""
    return with_problems(file_metrics(source_files(files), carry=["text", "extractor"]))


def _described(measured: DataFrame) -> DataFrame:
    return with_classes(with_functions(with_smells(measured))).drop("text", "extractor")


def advised_profile(files: DataFrame, show_all: bool = False, most: int = ranking.ADVISED_FILES) -> DataFrame:
    """The rows of :func:`profile` that advice is given for; files are ranked by their metrics, and only the first are described."""
    top = ranking.top_files(_measured(files), show_all).orderBy(*ranking.by_debt()).limit(most)
    return _described(top)


def reported_profile(files: DataFrame) -> DataFrame:
    """The rows of :func:`profile` that may be reported, which are those with a problem or a debt of 5; only they are described."""
    return _described(_measured(files).filter((F.size("problems") > 0) | (F.col("debt_score") >= 5)))


def report_profile(files: DataFrame, functions: bool = True) -> DataFrame:
    """The part of :func:`profile` that decides what is reported: files with a problem or a debt of 5.

    Functions are told unless they only have to decide; they and smells are looked for where
    nothing else speaks for a file yet, and smells are only counted.
    """
    measured = _measured(files)
    no_problem = F.size("problems") == 0
    worth = measured.filter(~no_problem | (F.col("debt_score") >= 5))
    if not functions:
        worth = worth.withColumn("text", F.when(no_problem, F.col("text")))
    described = with_functions(worth, parts=hotspots.PARTS if functions else ())
    silent = described.withColumn("text", F.when(no_problem & (F.size("functions") == 0), F.col("text")))
    return with_smells(silent, parts=()).drop("text", "extractor")


def write_profile(files: DataFrame, path: str) -> DataFrame:
    """Write :func:`profile` as Parquet, partitioned for nothing, and read it back."""
    profile(files).write.mode("overwrite").parquet(path)
    return read_profile(files.sparkSession, path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
