"""Profiles that measure no text twice: kept up to date, and with each content measured once.

A text is known by the digest of its bytes; a corpus may bring one as the column ``digest``, and
then unchanged texts are not even read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from debtscope.operators import rollup
from debtscope.plans.profile_table import profile, read_profile
from debtscope.sources import corpus as C

Measure = Callable[..., DataFrame]

#: Most files (a key each) that are broadcast to pick their texts; more are joined by a shuffle of the texts.
BROADCAST_KEYS = 500_000


def with_digest(files: DataFrame) -> DataFrame:
    """Key the files and add the digest of their content unless they bring one; a null content has a null digest."""
    keyed = C.with_file_id(files)
    return keyed if "digest" in keyed.columns else keyed.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))


def _named(keyed: DataFrame) -> DataFrame:
    """Files that a profile has a row for, without their texts."""
    return C.with_language(C.prune_directories(keyed.drop("content")))


def _picked(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The files, with texts, whose ``file_id`` is in the written table ``keys``."""
    few = keys.count() <= BROADCAST_KEYS
    # the side of the keys is hashed, so texts that have to be shuffled are not sorted
    return keyed.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), "file_id", "left_semi")


def _written(rows: DataFrame, path: str) -> DataFrame:
    """Write narrow rows that several later steps read, so that the texts behind them are read once."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_digested(files: DataFrame, path: str, measure: Measure = profile) -> DataFrame:
    """Write a profile, or what else ``measure`` makes of the files, that :func:`update_profile` can start from."""
    measure(with_digest(files), "digest").write.mode("overwrite").parquet(path)
    return read_profile(files.sparkSession, path)


def update_profile(files: DataFrame, before: str, after: str, folder: str, measure: Measure = profile) -> DataFrame:
    """Write to ``after`` the profile of ``files``, measuring only those that the profile at ``before`` does not have as they are.

    ``files`` is the whole corpus as it is now; files that are gone drop out.  The keys of new and
    changed files and the digests of all are written below ``folder``, which all executors share.
    ``measure`` is that of the profile at ``before``.
    """
    spark, keyed = files.sparkSession, with_digest(files)
    known = read_profile(spark, before)
    now = _written(_named(keyed).select("file_id", "digest"), f"{folder}/now")
    same = (F.col("now.file_id") == F.col("old.file_id")) & F.col("now.digest").eqNullSafe(F.col("old.digest"))
    keys = known.select("file_id", "digest")
    now.alias("now").join(keys.alias("old"), same, "left_anti").select("file_id").write.mode("overwrite").parquet(f"{folder}/changed")
    measured = measure(_picked(keyed, spark.read.parquet(f"{folder}/changed")), "digest")
    kept = known.alias("old").join(now.alias("now"), same, "left_semi")
    measured.unionByName(kept.select(measured.columns)).write.mode("overwrite").parquet(after)
    return read_profile(spark, after)


def merged_rollup(before: DataFrame, gone: DataFrame, came: DataFrame) -> DataFrame:
    """The language rollup after an update, from the one before and the profile rows that went and came.

    Sums are carried on, so neither the corpus nor the whole profile is read again.
    """
    counts = [c for c in before.columns if c not in ("lang", "avg_cc")]
    signed = [(before, 1), (rollup.language_rollup(came), 1), (rollup.language_rollup(gone), -1)]
    parts = [rows.select("lang", *[(F.col(c) * sign).alias(c) for c in counts]) for rows, sign in signed]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang").agg(*[F.sum(c).alias(c) for c in counts])
    return merged.filter(F.col("files") > 0).withColumn("avg_cc", rollup.average_complexity(F.col("cc"), F.col("files"))).select(before.columns)


def changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profile rows that went and those that came between two digested profiles."""
    same = (F.col("a.file_id") == F.col("b.file_id")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
    return before.alias("a").join(after.alias("b"), same, "left_anti"), after.alias("a").join(before.alias("b"), same, "left_anti")


def profile_contents(files: DataFrame, folder: str, measure: Measure = profile) -> DataFrame:
    """The profile of ``files``, or what else ``measure`` makes of them, with every content measured once per file type.

    Of the files with equal content and extension, vendored copies for instance, the one with the
    smallest key is measured; its measures are joined to the names of all.  Names, keys and
    measures are written below ``folder``, which all executors share.
    """
    spark, keyed = files.sparkSession, with_digest(files)
    names = _written(_named(keyed).select("file_id", "repo", "path", "digest", "ext"), f"{folder}/names")
    names.groupBy("digest", "ext").agg(F.min("file_id").alias("file_id")).select("file_id").write.mode("overwrite").parquet(f"{folder}/measured")
    own = measure(_picked(keyed, spark.read.parquet(f"{folder}/measured")), "digest", "ext")
    columns = [c for c in own.columns if c not in ("digest", "ext")]
    by_path = {"file_id": F.col("n.file_id"), "repo": F.col("n.repo"), "path": F.col("n.path"), "is_exempt": C.exempt(F.col("n.path"))}
    own.write.mode("overwrite").parquet(f"{folder}/contents")
    same = F.col("n.digest").eqNullSafe(F.col("m.digest")) & (F.col("n.ext") == F.col("m.ext"))
    joined = names.alias("n").join(spark.read.parquet(f"{folder}/contents").alias("m"), same)
    return joined.select(*[by_path.get(c, F.col(f"m.{c}")).alias(c) for c in columns])
