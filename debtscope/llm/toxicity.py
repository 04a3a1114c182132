"""Toxicity: character n-gram linear classifier on naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from debtscope.llm import labelled, linear
from debtscope.llm.common import CHUNK

#: Hashed features of all orders.
SIZE = 1 << 20
#: Lengths of the n-grams, in characters of the lower-cased text with one space in front and behind.
ORDERS = (3, 4, 5)
#: Most labelled documents that a model is fitted on.
MAX_ROWS = 2500
#: Texts from this score on count as toxic.
THRESHOLD = 0.5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1_000_003)


def features() -> Callable[[str], np.ndarray]:
    """A function from a text to its distinct features; it keeps its tables from text to text."""
    distinct, reach = linear.Distinct(SIZE), max(ORDERS) - 1

    def of(text: str) -> np.ndarray:
        distinct.start()
        found, text = [], f" {text.lower()} "
        for start in range(0, len(text), CHUNK):
            chars = np.frombuffer(text[start : start + CHUNK + reach].encode("utf-32-le"), np.uint32).astype(np.uint64)
            code = np.zeros(len(chars), np.uint64)
            for order in range(1, max(ORDERS) + 1):
                if len(chars) < order:
                    break
                code = code[: len(chars) - order + 1] * _BASE + chars[order - 1 :]
                if order in ORDERS:
                    mixed = (code ^ np.uint64(order)) * _MIX
                    found.append(distinct.new((mixed >> np.uint64(44)).astype(np.int64)))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    return of


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> linear.LinearModel:
    """Fit on at most ``max_rows`` documents with a label (``doc_id``, ``label`` 0 or 1).

    No labelled rows, or one label only: every text gets the smoothed share of label 1.
    """
    rows, own = labelled.sample_features(documents, labels, features, max_rows)
    return linear.fit(rows, own, SIZE)


def score(text: Column, model: linear.LinearModel) -> Column:
    """Probability that each whole text is toxic; null counts as the empty text."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = features()
        for texts in batches:
            margin = [linear.margins([of(x or "")], model.weights, model.bias)[0] for x in texts]
            yield pd.Series(model.probability(np.array(margin)).astype(float))

    return scored(text)
