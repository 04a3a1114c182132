"""Removal of byte strings that occur elsewhere, by a distributed merge sort of suffixes.

A string of :data:`LENGTH` bytes that starts at two places is to go at both.  Sorting a suffix
for every byte of the corpus would multiply it, so suffixes are thinned without losing a match:

1. Anchors.  Each window of ``LENGTH`` bytes is given the place of its smallest :data:`GRAM`-byte
   gram (by hash).  Equal windows have it at the same offset.  Neighbouring windows with one
   anchor make a stretch.  Anchors whose gram is unique, and so all windows around them, are
   done; stretches that occur again as a whole are duplicates as a whole.
2. Suffixes.  What is left are stretches at the ends of repeated passages.  For them and one copy
   of each stretch they may match, a suffix is taken at every :data:`GRID`-th byte, with the few
   bytes in front of it.  A task sorts its suffixes and front-codes them: each is stored as the
   length of the prefix shared with the one before, and the rest.
3. Merge.  The runs of a part of the key space meet in one task and are merged by a loser tree
   that keeps the prefix each candidate shares with the last winner, so shared prefixes are
   never compared again.  The merged order gives every shared prefix between neighbours, and with
   the bytes in front all windows that occur twice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from debtscope.llm.common import saved

#: Bytes of a string that may not occur twice, of an anchor's gram, and between suffixes of a stretch.
LENGTH, GRAM, GRID = 400, 256, 16
#: Window starts that are expanded into arrays at once.
SEGMENT = 1 << 20
#: Suffixes per part of the merge, on average, and per run that travels as one row.
PART, RUN = 40_000, 4096

_WIDTH = LENGTH - GRAM + 1  # grams of a window
_PLACE = np.uint64((1 << 21) - 1)
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_UP, _DOWN = _powers(SEGMENT + 4 * LENGTH)


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of texts that stand in a row in ``data`` (at most a segment), text ``i`` ending at ``ends[i]``.

    Arrays of text number, first window start, number of windows, offset of the anchor from the
    first start, hash of the anchor's gram and hash of the whole stretch.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _DOWN[: len(data)], out=sums[1:])
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * _UP[: len(data) - GRAM + 1])
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach * 2 <= _WIDTH:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = _WIDTH - reach
    low = np.minimum(low[: len(low) - rest], low[rest:])[:n]
    anchor = (low & _PLACE).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + LENGTH <= ends[text]
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    first, count = first[inside[first]], count[inside[first]]
    place = anchor[first]
    stop = first + count - 1 + LENGTH
    whole = (sums[stop] - sums[first]) * _UP[first]
    whole = _mixed(whole + _mixed((count.astype(np.uint64) << np.uint64(12)) + (place - first).astype(np.uint64)))
    return text[first], first, count, place - first, grams[place].view(np.int64), whole.view(np.int64)


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of many texts: (text, first start, windows, offset, gram hash, stretch hash), long texts segment by segment."""
    group, size = [], 0

    def flush():
        ends = np.cumsum([len(texts[i]) for i in group])
        data = np.frombuffer(b"".join([texts[i] for i in group]), np.uint8)
        text, first, *rest = stretches(data, ends)
        starts = np.concatenate([[0], ends])[:-1]
        return np.array(group)[text], first - starts[text], *rest

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > SEGMENT:
            for begin in range(0, len(text) - LENGTH + 1, SEGMENT):
                part = np.frombuffer(text[begin : begin + SEGMENT + LENGTH - 1], np.uint8)
                own, first, *rest = stretches(part, np.array([len(part)]))
                yield np.full(len(own), i), first + begin, *rest
            continue
        if size + len(text) > SEGMENT:
            yield flush()
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        yield flush()


def anchor_rows(texts: DataFrame) -> DataFrame:
    """One row per stretch: ``gram``, ``whole``, ``key``, ``first``, ``shape`` (windows and offset)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].to_numpy(np.int64)
            for text, first, count, offset, gram, whole in anchors([(x or "").encode() for x in batch["text"]]):
                shape = (count << 10 | offset).astype(np.int32)
                yield pd.DataFrame({"gram": gram, "whole": whole, "key": keys[text], "first": first, "shape": shape})

    return texts.select("key", "text").mapInPandas(build, "gram long, whole long, key long, first long, shape int")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the shared prefix, of which ``known`` bytes are known already."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, high = known, most
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_coded(suffixes: list[bytes]) -> tuple[list[int], bytes, list[int]]:
    """Shared prefix with the suffix before, all rests in a row, and their lengths, of sorted suffixes."""
    shared, rests, last = [], [], b""
    for suffix in suffixes:
        n = common_prefix(last, suffix)
        shared.append(n)
        rests.append(suffix[n:])
        last = suffix
    return shared, b"".join(rests), [len(x) for x in rests]


def decoded(shared, rests: bytes, lengths) -> Iterator[tuple[bytes, int]]:
    """Suffixes of a front-coded run with the prefix each shares with the one before."""
    last, at = b"", 0
    for n, length in zip(map(int, shared), map(int, lengths)):
        last = last[:n] + rests[at : at + length]
        at += length
        yield last, n


class LoserTree:
    """Merges sorted runs of (suffix, prefix shared with the one before).

    Each candidate carries the prefix it shares with the last winner.  Of two candidates the one
    that shares more is smaller; only equal shares make a comparison, which starts behind the
    shared bytes.  What the loser of a match shares with its winner is what it needs when it is
    next met.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self._runs = runs
        self._size = 1 << max(0, len(runs) - 1).bit_length()
        self._head: list[bytes | None] = [None] * self._size
        self._share = [0] * self._size
        for i, run in enumerate(runs):
            self._head[i] = next(run, (None, 0))[0]
        self._loser = [0] * self._size
        self._winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self._size:
            return node - self._size
        winner, self._loser[node] = self._match(self._play(2 * node), self._play(2 * node + 1))
        return winner

    def _match(self, a: int, b: int) -> tuple[int, int]:
        x, y, share = self._head[a], self._head[b], self._share
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        n = common_prefix(x, y, share[a])
        if x[n : n + 1] <= y[n : n + 1]:
            share[b] = n
            return a, b
        share[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Number of the run whose head comes next, and the prefix it shares with the one before."""
        while self._head[self._winner] is not None:
            run = self._winner
            yield run, self._share[run]
            self._head[run], self._share[run] = next(self._runs[run], (None, 0))
            node, winner = (self._size + run) // 2, run
            while node:
                winner, self._loser[node] = self._match(winner, self._loser[node])
                node //= 2
            self._winner = winner


def run_rows(texts: DataFrame, parts: int) -> DataFrame:
    """Sorted, front-coded runs of suffixes from rows of ``key``, ``text`` and ``open`` (stretches), by ``part``."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[int, list[tuple]] = {}
            for key, text, open_ in zip(batch["key"], batch["text"], batch["open"]):
                data = text.encode()
                for stretch in open_:
                    first, count, offset = stretch["first"], stretch["shape"] >> 10, stretch["shape"] & 1023
                    place, least = first + offset, offset - count + 1
                    for step in range(least // GRID, offset // GRID + 1):
                        at = place - step * GRID
                        suffix = data[at : at + LENGTH]
                        if len(suffix) <= LENGTH - GRID:
                            continue
                        low, high = max(least - step * GRID, 0), min(offset - step * GRID, GRID - 1)
                        front = data[max(0, at - GRID + 1) : at][::-1]
                        part = int.from_bytes(sha256(suffix[: LENGTH - GRID + 1]).digest()[:6], "big") % parts
                        found.setdefault(part, []).append((suffix, front, key, at, low, high))
            out = []
            for part, rows in found.items():
                rows.sort()
                for i in range(0, len(rows), RUN):
                    suffix, front, key, at, low, high = zip(*rows[i : i + RUN])
                    shared, rests, lengths = front_coded(list(suffix))
                    out.append((part, shared, rests, lengths, list(front), list(key), list(at), list(low), list(high)))
            yield pd.DataFrame(out, columns=["part", "shared", "rests", "lengths", "front", "key", "at", "low", "high"])

    return texts.mapInPandas(build, _RUN_SCHEMA)


_RUN_SCHEMA = (
    "part int, shared array<short>, rests binary, lengths array<short>, front array<binary>, key array<long>, at array<long>,"
    " low array<byte>, high array<byte>"
)


def _repeats(group: list[tuple[int, tuple]]) -> Iterator[tuple[int, int, int]]:
    """Spans (key, begin, end) of the windows that occur twice among suffixes sharing more than ``LENGTH - GRID`` bytes.

    The window ``e`` bytes in front of a suffix is equal to another if ``LENGTH - e`` bytes of
    the suffixes and the ``e`` bytes in front are.
    """
    found: dict[int, list[int]] = {}
    for e in range(GRID):
        label, names = 0, []
        for share, (front, _, _, low, high) in group:
            if share < LENGTH - e:
                label += 1
            names.append((label, front[:e]) if low <= e <= high else None)
        counts = Counter(names)
        for i, name in enumerate(names):
            if name is not None and counts[name] > 1:
                found.setdefault(i, []).append(e)
    for i, windows in found.items():
        _, key, at, _, _ = group[i][1]
        begin = windows[0]
        for now, after in zip(windows, [*windows[1:], -1]):
            if after != now + 1:
                yield key, at - now, at - begin + LENGTH
                begin = after


def merged(runs: DataFrame) -> DataFrame:
    """Spans (``key``, ``begin``, ``end``) of repeated windows, from the runs of each part merged by a loser tree."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        sources = [decoded(s, r, n) for s, r, n in zip(part["shared"], part["rests"], part["lengths"])]
        notes = [zip(*x) for x in zip(part["front"], part["key"], part["at"], part["low"], part["high"])]
        out, group = [], []
        for run, share in LoserTree(sources):
            if share <= LENGTH - GRID:
                if len(group) > 1:
                    out += _repeats(group)
                group = []
            group.append((share, next(notes[run])))
        if len(group) > 1:
            out += _repeats(group)
        return pd.DataFrame(out, columns=["key", "begin", "end"]).astype("int64")

    return runs.groupBy("part").applyInPandas(merge, "key long, begin long, end long")


def repeated_spans(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``key`` and ``spans`` (array of ``begin``, ``end``), and the texts of those keys, from rows of ``key`` and ``text``.

    Equal texts have one key.
    """
    rows = anchor_rows(texts)
    gram, whole = Window.partitionBy("gram"), Window.partitionBy("gram", "whole")
    rows = rows.withColumn("copies", F.count("*").over(whole))
    rows = rows.withColumn("turn", F.row_number().over(whole.orderBy("key", "first")))
    rows = rows.withColumn("all", F.count("*").over(gram)).filter("all > 1")
    rows = rows.withColumn("alone", F.sum((F.col("copies") == 1).cast("int")).over(gram))
    rows = saved(rows.filter("copies > 1 or alone > 0").select("key", "first", "shape", "copies", "turn", "alone"))
    windows = F.shiftright("shape", 10)
    certain = rows.filter("copies > 1").select("key", F.col("first").alias("begin"), (F.col("first") + windows - 1 + LENGTH).alias("end")).distinct()
    open_ = rows.filter("alone > 0 and turn = 1").groupBy("key").agg(F.collect_list(F.struct("first", "shape")).alias("open"))
    distinct = texts.groupBy("key").agg(F.first("text").alias("text"))  # equal texts meet before they are shuffled
    marked = rows.select("key").distinct()
    kept = saved(distinct.join(marked, "key", "left_semi"))
    work = kept.join(open_, "key")
    total = rows.filter("alone > 0 and turn = 1").count()
    runs = run_rows(work, max(1, total * 5 // PART))
    spans = certain.unionByName(merged(runs)).groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return spans, kept


def joined(spans) -> list[tuple[int, int]]:
    """Spans put together into maximal ones."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def without_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each document.

    Every byte covered by a :data:`LENGTH`-byte string that also starts anywhere else goes; texts
    are UTF-8 bytes, null counts as empty, matches never cross documents and overlaps count.
    Repeated rows are copies of each other.  No rows give no rows.
    """
    documents = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    documents = documents.withColumn("key", F.xxhash64("text"))
    spans, kept = repeated_spans(documents.select("key", "text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, own in zip(batch["key"], batch["text"], batch["spans"]):
                data, spans_ = text.encode(), joined(own)
                left, at = sha256(), 0
                for begin, end in spans_:
                    left.update(data[at:begin])
                    at = end
                left.update(data[at:])
                out.append((key, sum(e - b for b, e in spans_), len(spans_), left.hexdigest()))
            yield pd.DataFrame(out, columns=["key", "n_removed", "n_spans", "sha"])

    changed = kept.join(spans, "key").mapInPandas(cut, "key long, n_removed long, n_spans long, sha string")
    rows = documents.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("plain"))
    rows = rows.join(saved(changed), "key", "left")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("sha", "plain").alias("kept_sha256"),
    )
