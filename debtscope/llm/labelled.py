"""A bounded sample of labelled documents as feature arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def sample_features(
    documents: DataFrame, labels: DataFrame, features: Callable[[], Callable[[str], np.ndarray]], max_rows: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature arrays and labels of at most ``max_rows`` labelled documents.

    ``labels`` has ``doc_id`` and ``label`` (0 or 1); other labels and null keys are left out and
    of several labels for one key the larger counts.  The documents are chosen by a hash of
    their key, so the choice does not follow their order.  Only keys, labels and distinct
    features travel, never texts; the order of the result is fixed.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select("doc_id", "text").filter("text is not null")
    joined = texts.join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = features()
        for batch in batches:
            found = [np.sort(own(text)).astype(np.int32) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "features": found})

    rows = joined.mapInPandas(extract, "doc_id long, label int, features array<int>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    return [np.asarray(x, np.int64) for x in rows["features"]], rows["label"].to_numpy()
