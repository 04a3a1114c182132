"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each Arrow batch of documents (bounded by bytes) is a shard with a word-level suffix array of
its own.  Every suffix of every benchmark item is binary-searched in it, so all verbatim matches
with their places come out; they are extended to their full length.  The benchmark travels in
blocks of bounded size; a document is one row and no text is ever shuffled.

Words are compared by a 64-bit hash.  Stretches that hold a word foreign to the benchmark cannot
match, so only runs of known words of at least a window's length enter the array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from debtscope.llm.common import trim
from debtscope.llm.words import ALPHANUMERIC, word_hashes

#: Words of a window; an item of fewer words is one window as a whole.
WINDOW = 10
#: Most bytes of benchmark text that are broadcast at once; one longer item is a block of its own.
BLOCK_BYTES = 8 << 20

#: Pairs of an item's suffix and a place in the texts that are looked at together.
PAIRS = 1 << 18

MATCHES = "array<struct<item:string,item_word:int,doc_word:int,n_words:int>>"


@dataclass(frozen=True)
class Block:
    """Some benchmark items: sorted word hashes, the items' words as numbers from 1 with 0 behind each, and where items start."""

    items: list[str | None]
    vocabulary: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    window: int


def block(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Block:
    """A block of items; items without words have no window."""
    hashes, counts = word_hashes([text or "" for _, text in rows], ALPHANUMERIC)
    vocabulary = np.unique(hashes)
    numbers = np.searchsorted(vocabulary, hashes) + 1
    ends = np.cumsum(counts)
    words = np.concatenate([np.append(numbers[e - c : e], 0) for c, e in zip(counts, ends)] or [np.zeros(0, int)])
    sizes = np.asarray(counts, int)
    return Block([None if i is None else str(i) for i, _ in rows], vocabulary, words, np.cumsum(sizes + 1) - sizes - 1, sizes, window)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (numbers, 0 ends a run) sorted by their first ``depth`` words at least, by prefix doubling."""
    rank, reach = text.astype(np.int64), 1
    while reach < depth:
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:]
        ahead[rank == 0] = 0
        key = rank * (int(rank.max()) + 1) + ahead
        _, rank = np.unique(key, return_inverse=True)
        if key.min() > 0:
            rank = rank + 1
        reach *= 2
    return np.argsort(rank, kind="stable")


def _narrow(text: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray):
    """Binary search, for all ranges at once, of the part whose suffixes have ``word`` at ``depth``."""

    def bound(wanted: np.ndarray) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            middle = (a + b) // 2
            at = np.minimum(order[np.minimum(middle, len(order) - 1)] + depth, len(text) - 1)
            less = open_ & (text[at] < wanted)
            a = np.where(less, middle + 1, a)
            b = np.where(open_ & ~less, middle, b)
        return a

    return bound(word), bound(word + 1)


def search(texts: list[str], own: Block) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and all maximal matches as rows (text, item, item word, text word, words)."""
    hashes, counts = word_hashes(texts, ALPHANUMERIC)
    none = np.zeros((0, 5), np.int64)
    needs = np.where(own.sizes >= own.window, own.window, own.sizes)
    if not len(hashes) or not (needs > 0).any():
        return counts, none
    at = np.minimum(np.searchsorted(own.vocabulary, hashes), len(own.vocabulary) - 1)
    numbers = np.where(own.vocabulary[at] == hashes, at + 1, 0)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    # runs of known words inside one text that are long enough for the shortest window
    broken = np.ones(len(numbers), bool)
    broken[1:] = (doc[1:] != doc[:-1]) | (numbers[:-1] == 0) | (numbers[1:] == 0)
    first = np.flatnonzero(broken)
    length = np.diff(np.append(first, len(numbers)))
    good = (numbers[first] > 0) & (length >= needs[needs > 0].min())
    first, length = first[good], length[good]
    if not len(first):
        return counts, none
    # all runs in a row with a 0 behind each; place leads back to the words
    spot = np.cumsum(length + 1) - length - 1
    offset = np.arange(int((length + 1).sum())) - np.repeat(spot, length + 1)
    place = np.repeat(first, length + 1) + offset
    text = np.where(offset < np.repeat(length, length + 1), numbers[np.minimum(place, len(numbers) - 1)], 0)
    order = suffix_array(text, int(needs.max()))
    # every item suffix that still holds a whole window
    item = np.repeat(np.arange(len(own.sizes)), np.maximum(0, own.sizes - needs + 1) * (needs > 0))
    start = np.arange(len(item)) - np.searchsorted(item, item)
    query, need = own.starts[item] + start, needs[item]
    low, high = np.zeros(len(item), np.int64), np.full(len(item), len(order), np.int64)
    for depth in range(int(needs.max())):
        live = np.flatnonzero((low < high) & (need > depth))
        if len(live):
            low[live], high[live] = _narrow(text, order, low[live], high[live], depth, own.words[query[live] + depth])
    found = np.maximum(high - low, 0)
    if not found.any():
        return counts, none
    behind = np.cumsum(found)
    rows = [none]
    for begin in range(0, int(behind[-1]), PAIRS):
        pair = np.arange(begin, min(begin + PAIRS, int(behind[-1])))
        which = np.searchsorted(behind, pair, side="right")
        hit = order[low[which] + pair - (behind - found)[which]]
        # keep matches that do not begin one word earlier, and extend them as far as they go
        q = query[which]
        maximal = (start[which] == 0) | (hit == 0) | (text[hit - 1] != own.words[q - 1])
        which, hit, q = which[maximal], hit[maximal], q[maximal]
        size = need[which].copy()
        live = np.arange(len(which))
        while len(live):
            word = text[np.minimum(hit[live] + size[live], len(text) - 1)]
            live = live[(word > 0) & (word == own.words[q[live] + size[live]])]
            size[live] += 1
        word = place[hit]
        rows.append(np.stack([doc[word], item[which], start[which], word - (ends - counts)[doc[word]], size], axis=1))
    return counts, np.concatenate(rows)


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[Block]:
    """The benchmark (``item_id``, ``text``) in blocks of about ``block_bytes`` at most.

    Items are dealt to blocks by a hash; repeated items and items without text do no harm.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [block([tuple(r) for r in rows.filter(part == i).collect()], window) for i in range(n)]


def find(text: Column, own: list[Block]) -> Column:
    """Struct of ``n_words``, ``n_hit`` (words inside a match) and ``matches`` for each whole text.

    Matches are maximal; an item may match at several places.  A null or wordless text has none.
    """

    def covered(found) -> int:
        total = at = 0
        for begin, end in sorted((m["doc_word"], m["doc_word"] + m["n_words"]) for m in found):
            total += max(0, end - max(begin, at))
            at = max(at, end)
        return total

    def one(part: Block) -> Column:
        @F.pandas_udf(f"n_words long, n_hit long, matches {MATCHES}")
        def searched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                counts, rows = search([x or "" for x in texts], part)
                matches: list[list[dict]] = [[] for _ in range(len(texts))]
                for doc, item, item_word, doc_word, n in rows[np.lexsort(rows[:, ::-1].T)].tolist():
                    matches[doc].append({"item": part.items[item], "item_word": item_word, "doc_word": doc_word, "n_words": n})
                hits = np.array([covered(own) for own in matches], np.int64)
                yield pd.DataFrame({"n_words": counts.astype(np.int64), "n_hit": hits, "matches": matches})
            trim()

        return searched(text)

    if len(own) == 1:
        return one(own[0])

    @F.pandas_udf("long")
    def all_covered(rows: pd.Series) -> pd.Series:
        return pd.Series([covered(found) for found in rows], dtype="int64")

    found = [one(part) for part in own]
    matches = F.concat(*[x["matches"] for x in found])
    return F.struct(found[0]["n_words"].alias("n_words"), all_covered(matches).alias("n_hit"), matches.alias("matches"))


def remove(documents: DataFrame, own: list[Block]) -> DataFrame:
    """The documents without any hit, with all their columns; repeated rows are judged alike."""
    return documents.filter(find(F.col("text"), own)["n_hit"] == 0)
