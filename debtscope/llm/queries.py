"""Registered queries of this subpackage: each operator over its whole table, with digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from debtscope.llm import (
    bpe,
    decontamination,
    jaccard,
    langid,
    merkle,
    minhash,
    neighbours,
    quality,
    resampling,
    secret_scan,
    sharding,
    suffixes,
    toxicity,
)
from debtscope.llm.common import held_out, table

#: Vocabulary file of the encoding query and stage.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Labels of the learning fold as (doc_id, label)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(name).alias("label"))
    return labels.filter(~held_out(F.col("doc_id"), 5, 0))


def _scored(spark: SparkSession, sf_dir: str, name: str, operator) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = operator.train(documents, _labels(spark, sf_dir, name))
    scored = documents.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), operator.score(F.col("text"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= operator.THRESHOLD).cast("int"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a benchmark window, and the items they come from."""
    own = decontamination.blocks(table(spark, sf_dir, "benchmark"))
    found = table(spark, sf_dir, "documents").select("doc_id", decontamination.find(F.col("text"), own).alias("found"))
    items = F.array_sort(F.array_distinct(F.filter(F.col("found.matches.item"), lambda x: x.isNotNull())))
    found = found.select("doc_id", "found.n_words", "found.n_hit", items.alias("items"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.shards(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; the digests are taken of ids and decoded text."""
    documents = table(spark, sf_dir, "documents")
    coded = documents.select("doc_id", bpe.encode_decode(F.col("text"), bpe.encoder(spark, VOCABULARY)).alias("coded"))
    return coded.select(
        "doc_id",
        "coded.n_tokens",
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels outside the held-out fold."""
    return _scored(spark, sf_dir, "toxic", toxicity)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from the labels outside the held-out fold."""
    return _scored(spark, sf_dir, "quality", quality)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return jaccard.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that long strings found elsewhere cover, and the digest of the rest."""
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts of the base kinds, digest of the base spans and all spans."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = secret_scan.train(documents)
    found = documents.select("doc_id", secret_scan.scan(F.col("text"), field).alias("found"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from documents outside the held-out fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = held_out(F.col("doc_id"), 3, 1)
    model = langid.train(documents.filter(~apart))
    found = documents.select("doc_id", apart.alias("held_out"), langid.identify(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.accepted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, checked against tampered texts."""
    return merkle.checked(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document when a quarter is drawn to look like the benchmark."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document, and whether it is the one that stays."""
    return minhash.deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_neighbours": op5_neighbours,
    "op6_quality": op6_quality,
    "op7_jaccard": op7_jaccard,
    "op8_suffixes": op8_suffixes,
    "op9_secrets": op9_secrets,
    "op10_language": op10_language,
    "op11_merkle": op11_merkle,
    "op12_resampling": op12_resampling,
    "op13_minhash": op13_minhash,
}

ORACLES: dict[str, str] = {"op2_sharding": sharding.ORACLE, "op11_merkle": merkle.ORACLE, "op12_resampling": resampling.ORACLE}
