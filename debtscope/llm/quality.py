"""Quality classifier: naive Bayes support vectors over word and shape n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from debtscope.llm import labelled, linear
from debtscope.llm.common import chunks, trim

#: Hashed features; single tokens, token pairs and shape triples share the table.
SIZE = 1 << 18
#: Most labelled documents that a model is fitted on.
MAX_ROWS = 4000
#: Documents with a lower score are rejected.
THRESHOLD = 0.3

_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * _MIX
    return ((values >> np.uint64(32)) % np.uint64(SIZE)).astype(np.int64)


def _shape(token: str) -> int:
    """A token's form: line end, digits, capitals, capitalised, lower case, or its first mark and length."""
    if token == "\n":
        return 1
    if token[0].isalnum() or token[0] == "_":
        if token.isdigit():
            return 2
        if token.isupper():
            return 3 if len(token) > 1 else 4
        return 5 if token[0].isupper() else 6
    return 7 + (ord(token[0]) * 3 + min(len(token), 3)) % 249


class _Codes(dict):
    """Token to its hash, length and shape; emptied when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        lower = token.lower().encode()
        code = self[token] = (crc32(lower) << 16 | (len(lower) & 255) << 8 | _shape(token))
        return code


def features() -> Callable[[str], np.ndarray]:
    """A function from a text to its distinct features; it keeps its tables from text to text."""
    codes, distinct = _Codes(), linear.Distinct(SIZE)

    def of(text: str) -> np.ndarray:
        distinct.start()
        found, last = [], np.zeros(0, np.uint64)
        for part in chunks(text):
            own = np.fromiter(map(codes.__getitem__, _TOKEN.findall(part)), np.uint64)
            own = np.concatenate([last, own])
            word, shape = own >> np.uint64(8), (own & np.uint64(255)) + np.uint64(1)
            pair = word[:-1] * np.uint64(31) + word[1:] * np.uint64(0xC2B2AE3D)
            triple = shape[:-2] * np.uint64(1 << 40) + shape[1:-1] * np.uint64(1 << 20) + shape[2:]
            for kind, values in enumerate((word, pair, triple, shape)):
                found.append(distinct.new(_mixed(values * np.uint64(8) + np.uint64(kind))))
            last = own[-2:]
        return np.concatenate(found)

    return of


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> linear.LinearModel:
    """Fit on at most ``max_rows`` documents with a label (``doc_id``, ``label`` 0 or 1).

    N-gram indicators are scaled by class log-count ratios; a linear hinge-loss model is fitted
    by dual coordinate descent and its margins are calibrated on documents left out in turn.
    No labelled rows, or one label only: every text gets the smoothed share of label 1.
    """
    rows, own = labelled.sample_features(documents, labels, features, max_rows)
    return linear.fit(rows, own, SIZE)


def score(text: Column, model: linear.LinearModel) -> Column:
    """Probability of label 1 of each whole text; null counts as the empty text."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = features()
        for texts in batches:
            margin = [linear.margins([of(x or "")], model.weights, model.bias)[0] for x in texts]
            yield pd.Series(model.probability(np.array(margin)).astype(float))
        del of  # its tables would stay until the next task
        trim()

    return scored(text)


def keep_good(documents: DataFrame, model: linear.LinearModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns; repeated rows are judged alike."""
    return documents.filter(score(F.col("text"), model) >= threshold)
