"""Approximate nearest neighbours by cross-polytope hashing.

A table turns all vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform); a vector's bucket is the signed axis it then lies closest to.  Every vector is in
one bucket of each table.  A query looks into the buckets of its closest axes, and all vectors
found there are ranked by their exact distance.

Buckets and the queries that look into them are joined by key.  Both are dealt into parts of
bounded size, so a group never grows with the table, and a part gives back only its nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from debtscope.llm.common import saved

#: Tables, and buckets a query looks into in each of them.
TABLES, PROBES = 8, 12
#: Neighbours per query.
NEAREST = 10
#: Rows of a bucket's part, and queries of a part, on average.
PART = 4096


def rotated(vectors: np.ndarray, table: int) -> np.ndarray:
    """The vectors, padded to a power of two, after the pseudo-rotation of a table."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    out = np.zeros((len(vectors), width))
    out[:, : vectors.shape[1]] = vectors
    rng = np.random.default_rng(1000 + table)
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], width)
        step = 1
        while step < width:
            pairs = out.reshape(len(out), width // (2 * step), 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def axes(vectors: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` closest signed axes of each unit vector, closest first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = rotated(unit, table)
    both = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def buckets(vector: Column, tables: int, probes: int) -> Column:
    """Array of ``table * 2^20 + axis`` of the buckets a vector is in or looks into."""

    @F.pandas_udf("array<int>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            if not len(rows):
                yield pd.Series([], dtype=object)
                continue
            data = np.stack([np.asarray(x, float) for x in rows])
            found = [axes(data, t, probes) + (t << 20) for t in range(tables)]
            yield pd.Series(list(np.concatenate(found, axis=1).astype(np.int32)))

    return hashed(vector)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, as (``vec_id``, ``vector``): a key, and a finite vector that is not zero.

    Of several vectors for one key the smallest counts.  Vectors of another length than the most
    frequent one (the longest, on a tie) take no part.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).filter("vec_id is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("vector") == (lengths["n"] if lengths else 0))


def nearest(vectors: DataFrame, every: int = 100, count: int = NEAREST, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """The ``count`` nearest vectors of each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    ``vectors`` has ``vec_id`` and ``embedding``; queries are the rows whose key ``every``
    divides.  ``score`` is the Euclidean distance in double precision, ties go to the smaller
    key.  A query for which the tables give fewer than ``count`` looks into all their buckets.
    """
    rows = saved(usable(vectors))
    total = rows.count()
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    # of equal vectors only the first count + 1 keys can be among anyone's nearest
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    index = rows.withColumn("place", place).filter(F.col("place") <= count + 1).drop("place")
    found = saved(_ranked(_pass(index, queries, total, every, count, tables, probes), count))
    short = queries.join(found.filter(F.col("rank") == min(count, total - 1)), "query_id", "left_anti")
    if total > 1 and not short.isEmpty():
        more = _ranked(_pass(index, short, total, every, count, 1, 1 << 20), count)
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(more)
    return found


def _pass(index: DataFrame, queries: DataFrame, total: int, every: int, count: int, tables: int, probes: int) -> DataFrame:
    """The nearest of each query within each part of each bucket it looks into."""
    row_parts = max(1, total // (64 * PART))
    query_parts = max(1, total // every * min(probes, 64) // (64 * PART))
    left = index.withColumn("bucket", F.explode(buckets(F.col("vector"), tables, 1)))
    left = left.withColumn("row_part", F.pmod(F.xxhash64("vec_id"), F.lit(row_parts)))
    left = left.withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    right = queries.withColumn("bucket", F.explode(buckets(F.col("query"), tables, probes)))
    right = right.withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int"))
    right = right.withColumn("row_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_parts - 1).cast("long"))))
    key = ["bucket", "row_part", "query_part"]

    def rank(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            data, keys = np.stack([np.asarray(x, float) for x in rows["vector"]]), rows["vec_id"].to_numpy()
            for query, vector in zip(asked["query_id"], asked["query"]):
                far = np.sqrt(((data - np.asarray(vector, float)) ** 2).sum(axis=1))
                best = [i for i in np.lexsort((keys, far))[: count + 1] if keys[i] != query][:count]
                out += [(query, keys[i], far[i]) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(rank, "query_id long, vec_id long, score double")


def _ranked(pairs: DataFrame, count: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    pairs = pairs.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", place).filter(F.col("rank") <= count)
    return pairs.select("query_id", "rank", "vec_id", "score")
