"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from debtscope.llm.common import CHUNK

#: Hashed subwords and length of their embeddings.
BUCKETS, WIDTH = 1 << 16, 16  # the hash keeps 16 bits
#: Subword lengths, counted with the space in front of and behind a word; with the shortest, every letter is inside one.
ORDERS = (3, 4)
#: Most documents of one language that a model is fitted on.
MAX_ROWS_PER_LANGUAGE = 500
#: Share of right answers that accepted documents should reach.
TARGET = 0.99
#: Answer for texts without a letter, and for rejected ones.
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1_000_003)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their score per subword, bias, temperature and the confidence below which answers are rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Hashed subwords of the words of a whole text, in bounded pieces.

    Words are runs of letters in lower case; everything else counts as one space, which may
    begin or end a subword but never stands inside.
    """
    text, reach = f" {text.lower()} ", max(ORDERS) - 1
    for start in range(0, len(text), CHUNK):
        part = text[start : start + CHUNK + reach]
        chars = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        plain = letters()[chars]
        chars = np.where(plain, chars, 32).astype(np.uint64)
        code, inside = np.zeros(len(chars), np.uint64), np.ones(len(chars), bool)
        for order in range(1, max(ORDERS) + 1):
            n = len(chars) - order + 1
            if n <= 0:
                break
            code = code[:n] * _BASE + chars[order - 1 :]
            inside = inside[:n] & plain[order - 2 : order - 2 + n] if order > 2 else inside[:n]
            if order in ORDERS:
                yield (((code[inside] ^ np.uint64(order)) * _MIX) >> np.uint64(48)).astype(np.int64)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 5, rate: float = 0.5, seed: int = 5) -> LanguageModel:
    """Stochastic gradient descent over documents given as (subwords, shares).

    Every fifth document is kept back to set the temperature and the rejection threshold: the
    lowest confidence from which on at least :data:`TARGET` of the answers are right.
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, max(1, len(languages)))), np.zeros(max(1, len(languages)))
    own = np.array([languages.index(x) for x in labels], int)
    kept = np.arange(len(rows)) % 5 == 4
    learn = np.flatnonzero(~kept)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            buckets, shares = rows[i]
            if not len(buckets):
                continue
            hidden = shares @ embed[buckets]
            error = _softmax(hidden @ out + bias)
            error[own[i]] -= 1.0
            now = rate * (1 - done / steps)
            back = out @ error
            out -= now * np.outer(hidden, error)
            bias -= 0.1 * now * error
            # shares are tiny, so the embedding step is scaled up to the size of one subword's turn
            embed[buckets] -= now * np.minimum(1.0, shares * 40)[:, None] * back
            done += 1
    table = (embed @ out).astype(np.float32)
    scores = np.array([s @ table[b] + bias for b, s in rows]).reshape(len(rows), len(bias))
    test = np.flatnonzero(kept)
    temperature, threshold = 1.0, 0.0
    if len(test) and len(languages) > 1:
        options = np.geomspace(0.5, 20, 60)
        losses = [-np.log(_softmax(scores[test] / t)[np.arange(len(test)), own[test]] + 1e-12).mean() for t in options]
        temperature = float(options[int(np.argmin(losses))])
        p = _softmax(scores[test] / temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == own[test]
        order = np.argsort(-best)
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= TARGET)
        threshold = float(best[order][good[-1]]) if len(good) else 1.0
    return LanguageModel(languages, table, bias, temperature, threshold)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subwords of a text and their shares."""
    total = np.zeros(BUCKETS)
    for found in subwords(text):
        total += np.bincount(found, minlength=BUCKETS)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets] / max(1.0, total.sum())


def train(documents: DataFrame, max_rows: int = MAX_ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``max_rows`` documents of each language (``doc_id``, ``text``, ``lang``).

    Null languages and null texts are left out.  The documents are chosen by a hash of their
    key; of repeated keys one row is taken.  Only subword counts travel to the driver.
    Without any row the model knows no language and every text is :data:`UNKNOWN`.
    """
    rows = documents.filter("lang is not null and text is not null and doc_id is not null")
    keys = rows.select("doc_id", "lang")
    # the smallest hashes lie below a bound that the number of rows gives, four times as many as are wanted
    counts = keys.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), (4.0 * max_rows + 200) / F.col("n"))
    few = keys.join(counts, "lang").filter(F.xxhash64("doc_id").cast("double") <= -(2.0**63) + share * 2.0**64).select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = few.withColumn("place", F.row_number().over(first))
    chosen = chosen.filter(F.col("place") <= max_rows).select("doc_id", F.col("lang").alias("label")).dropDuplicates(["doc_id"])
    # at most max_rows keys per language, and languages are few
    joined = rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counted(text) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "label": batch["label"],
                    "buckets": [b.astype(np.int32) for b, _ in found],
                    "shares": [s.astype(np.float32) for _, s in found],
                }
            )

    sample = joined.mapInPandas(extract, "doc_id long, label string, buckets array<int>, shares array<float>").toPandas()
    sample = sample.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    pairs = [(np.asarray(b, np.int64), np.asarray(s, float)) for b, s in zip(sample["buckets"], sample["shares"])]
    return fit(pairs, list(sample["label"]))


def identify(text: Column, model: LanguageModel) -> Column:
    """Struct of ``lang``, ``score`` (its probability) and ``accepted`` for each whole text.

    ``lang`` is the likeliest language, :data:`UNKNOWN` with score 0 where the text is null or
    has no letter; ``accepted`` is false there and where the score is below the calibrated
    threshold.
    """

    @F.pandas_udf("lang string, score double, accepted boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                total, n = np.zeros(model.table.shape[1]), 0
                for buckets in subwords(text or ""):
                    total += np.ones(len(buckets), np.float32) @ model.table[buckets]
                    n += len(buckets)
                if n == 0 or not model.languages:
                    out.append((UNKNOWN, 0.0, False))
                    continue
                p = _softmax((total / n + model.bias) / model.temperature)
                best = int(p.argmax())
                out.append((model.languages[best], float(p[best]), bool(p[best] >= model.threshold)))
            yield pd.DataFrame(out, columns=["lang", "score", "accepted"])

    return found(text)
