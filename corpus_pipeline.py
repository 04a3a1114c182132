"""Training-data pipeline over ``documents``: quality, near copies, benchmark passages, secrets, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from debtscope.llm import bpe, decontamination, jaccard, quality, secret_scan
from debtscope.llm.common import SMALL_BATCH, batched, saved, table
from debtscope.llm.queries import VOCABULARY, _labels


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from labelled documents."""
    labels = _labels(spark, sf_dir, "quality")
    batched(spark, SMALL_BATCH)
    return quality.keep_good(docs, quality.train(docs, labels))


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that near-copy links connect."""
    batched(spark, SMALL_BATCH)
    return jaccard.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark window."""
    own = decontamination.blocks(table(spark, sf_dir, "benchmark"))
    batched(spark, SMALL_BATCH)
    return decontamination.remove(docs, own)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark; no document is dropped."""
    batched(spark, SMALL_BATCH)
    field = secret_scan.train(docs)
    return docs.withColumn("text", secret_scan.cleaned(F.col("text"), field)).withColumn("n_chars", F.length("text").cast("long"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text: key, language, source, number of tokens and the ids."""
    batched(spark, SMALL_BATCH)
    ids = bpe.encode(F.col("text"), bpe.encoder(spark, VOCABULARY))
    coded = docs.select("doc_id", "lang", "source", ids.alias("ids"))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", similar_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding", tokens_stage),
]

#: Classifiers, similarity links and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
