"""BPE encoding and decoding with word ends, by contiguous rank arrays.

The vocabulary is a public tokenizer file whose path is a parameter.  Texts are brought to NFC,
white space is folded, characters are lower-cased one by one, and words are split off by the
file's pattern.  A word is merged on its own, so results are kept per distinct word.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession, functions as F

from debtscope.llm.common import chunks, trim

#: Words of more parts are merged with a heap instead of repeated scans; the result is the same.
SHORT = 96
#: Short words are merged in groups of like size.
_WIDTHS = (0, 8, 12, 16, 24, 48, SHORT)
#: Bytes of stretches without white space, their ids and what Python spends on them, that are kept from text to text; beyond, all are forgotten.
KEPT_BYTES = 32 << 20
#: Characters that are split and merged together.
PORTION = 1 << 19

_FAR = 1 << 60
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


def _class(first: str) -> str:
    """Characters whose general category begins with a letter, as ranges for a character class."""
    out, start = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == first
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


#: What the classes of the file's pattern stand for.
_CLASSES = {
    r"\p{L}": cache(lambda: _class("L")),
    r"\p{N}": cache(lambda: _class("N")),
    r"\s": lambda: r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000",
}


class Encoder:
    """Encodes and decodes texts as the vocabulary file says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self._vocab: dict[str, int] = dict(model["vocab"])
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._end = model["end_of_word_suffix"] or ""
        self._letters = byte_letters()
        self._token = {i: t for t, i in self._vocab.items()} | {i: t for t, i in self._special.items()}
        # texts of the ids and their tokens, looked up by whole arrays of ids
        self._id_texts, self._tokens = (np.full(max(self._token) + 1, "", object) for _ in range(2))
        for i, token in self._token.items():
            self._id_texts[i], self._tokens[i] = str(i), token
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # rank of each pair of ids, the pair packed into one number; merged id of each rank
        self._ranks = {self._vocab[a] << 20 | self._vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self._merged = np.array([self._vocab[a + b] for a, b in merges] + [0], np.int64)
        order = np.argsort(np.array(list(self._ranks), np.int64))
        self._pairs, self._pair_ranks = np.array(list(self._ranks), np.int64)[order], order
        # ids of a byte inside and at the end of a word; bytes that the vocabulary lacks are left out
        self._inner = np.array([self._vocab.get(x, -1) for x in self._letters], np.int64)
        self._last = np.array([self._vocab.get(x + self._end, -1) for x in self._letters], np.int64)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        for name, members in _CLASSES.items():
            split = split.replace(f"[{name}]", f"[{members()}]").replace(name, members())
        self._words = re.compile(split)
        self._cut = re.compile("|".join(re.escape(t) for t in sorted(self._special, key=len, reverse=True)) or r"(?!)")
        self._known: dict[str, bytes] = {}
        self._known_bytes = 0

    # -- words ------------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``_FAR`` for pairs that never merge (gaps are -1)."""
        pair = np.where((left < 0) | (right < 0), -1, left << 20 | right)
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._pair_ranks[at], _FAR)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of words: bytes are the parts, the last one marked as word end, merged by rank."""
        out: list[list[int]] = [[]] * len(words)
        data = [word.encode("utf-8") for word in words]
        size = np.array([len(x) for x in data], np.int64)
        for low, high in zip(_WIDTHS, _WIDTHS[1:]):
            rows = np.flatnonzero((size > low) & (size <= high))
            if len(rows):
                for row, ids in zip(rows, self._scan([data[i] for i in rows], size[rows])):
                    out[row] = ids
        for row in np.flatnonzero(size > SHORT):
            parts = np.append(self._inner[list(data[row][:-1])], self._last[data[row][-1]])
            out[row] = self._heap(parts[parts >= 0].tolist())
        return out

    def _scan(self, data: list[bytes], size: np.ndarray) -> list[list[int]]:
        """Merge many short words side by side, a row of parts and a row of adjacent ranks for each.

        A step takes each row's smallest rank, deletes the boundary behind it and refreshes the
        ranks on its two sides; rows without a mergeable pair are finished.
        """
        n, width = len(data), int(size.max()) + 1  # one gap at least behind each word
        parts = np.full((n, width), -1, np.int64)
        letters = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(n), size)
        column = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
        parts[row, column] = np.where(column == size[row] - 1, self._last[letters], self._inner[letters])
        if (parts[row, column] < 0).any():  # close the gaps of bytes that the vocabulary lacks
            parts = np.take_along_axis(parts, np.argsort(parts < 0, axis=1, kind="stable"), axis=1)
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        out: list[list[int]] = [[]] * n
        live = np.arange(n)
        while len(live):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(live)), at]
            ended = least == _FAR
            if ended.any():
                for i, ids in zip(live[ended], parts[ended].tolist()):
                    out[i] = [x for x in ids if x >= 0]
                live, parts, ranks, at, least = (x[~ended] for x in (live, parts, ranks, at, least))
                if not len(live):
                    break
            rows, width = np.arange(len(live)), parts.shape[1]
            parts[rows, at] = self._merged[least]
            kept = np.ones(parts.shape, bool)
            kept[rows, at + 1] = False
            parts = parts[kept].reshape(len(live), width - 1)
            kept = np.ones(ranks.shape, bool)
            kept[rows, at] = False
            ranks = ranks[kept].reshape(len(live), width - 2)
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self._rank(parts[right, at[right]], parts[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._rank(parts[left, at[left] - 1], parts[left, at[left]])
        return out

    def _heap(self, parts: list[int]) -> list[int]:
        """The same merges for long words, in n log n steps."""
        table, n = self._ranks, len(parts)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(table[pair], i, pair) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (pair := a << 20 | b) in table]
        heapq.heapify(queue)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (pair := parts[i] << 20 | parts[j]) in table:
                heapq.heappush(queue, (table[pair], i, pair))

        while queue:
            rank, i, pair = heapq.heappop(queue)
            if not live[i] or (j := after[i]) >= n or parts[i] << 20 | parts[j] != pair:
                continue
            parts[i], live[j], after[i] = int(self._merged[rank]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p, kept in zip(parts, live) if kept]

    # -- whole texts ------------------------------------------------------------------------

    def _pieces(self, text: str) -> list[str]:
        """A text's special tokens and its stretches without white space, in order."""
        out, at = [], 0
        for hit in self._cut.finditer(text):
            out += self._plain(text[at : hit.start()])
            out.append(hit.group())
            at = hit.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        # characters are lower-cased one by one, so a sigma at a word end is no special case; white
        # space needs no folding, as no word holds any
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        if _SEPARATORS.search(text):  # split() takes these for white space, the pattern does not
            return self._words.findall(text)
        return text.split()

    def _learn(self, pieces: set[str]) -> None:
        """Keep the ids of pieces, each as the bytes of an array."""
        order = [piece for piece in pieces if piece not in self._special]
        words = [(piece,) if piece.isalpha() else self._words.findall(piece) for piece in order]
        distinct = list({word for own in words for word in own})
        ids = {word: np.array(own, np.int32).tobytes() for word, own in zip(distinct, self.merge(distinct))}
        new = {token: np.int32(i).tobytes() for token, i in self._special.items() if token in pieces}
        new |= {piece: b"".join([ids[word] for word in own]) for piece, own in zip(order, words)}
        self._known_bytes += sum(len(piece) + len(own) + 150 for piece, own in new.items())
        self._known.update(new)

    def _coded(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of texts."""
        split = [self._pieces(part) for part in parts]
        if self._known_bytes > KEPT_BYTES:
            self._known, self._known_bytes = {}, 0
        known = self._known
        self._learn({piece for own in split for piece in own if piece not in known})
        return [b"".join([known[piece] for piece in own]) for own in split]

    def code(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; long texts are cut behind white space, where no word and no character reaches over."""
        out: list[list[bytes]] = [[] for _ in texts]
        owners, parts, size = [], [], 0

        def flush() -> None:
            for owner, ids in zip(owners, self._coded(parts)):
                out[owner].append(ids)

        for i, text in enumerate(texts):
            for part in chunks(text, PORTION):
                owners.append(i)
                parts.append(part)
                size += len(part)
                if size >= PORTION:
                    flush()
                    owners, parts, size = [], [], 0
        flush()
        return [np.frombuffer(b"".join(own), np.int32) for own in out]

    def encode(self, text: str) -> list[int]:
        return self.code([text])[0].tolist()

    def texts(self, ids: np.ndarray) -> tuple[str, str]:
        """Ids as text, joined by spaces, and the decoded text."""
        return " ".join(self._id_texts[ids].tolist()), " ".join(self._tokens[ids].tolist())

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined as a file without a decoder says; unknown ids are left out."""
        return " ".join(self._token[i] for i in ids if i in self._token)


@cache
def _loaded(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    own = Encoder(path)
    trim()
    return own


def encoder(spark: SparkSession, path: str):
    """A function that gives the tasks' encoder; the vocabulary file is sent to every executor once."""
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    return lambda: _loaded(SparkFiles.get(name))


def encode(text: Column, get) -> Column:
    """Array of ids of each whole text; a null text has none."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = get()
        for texts in batches:
            yield pd.Series(own.code([x or "" for x in texts]))
        trim()

    return encoded(text)


def encode_decode(text: Column, get) -> Column:
    """Struct of ``ids`` (joined by spaces), ``decoded`` and ``n_tokens`` of each whole text; null counts as empty."""

    @F.pandas_udf("ids string, decoded string, n_tokens long")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = get()
        for texts in batches:
            found = [(*own.texts(ids), len(ids)) for ids in own.code([x or "" for x in texts])]
            yield pd.DataFrame(found, columns=["ids", "decoded", "n_tokens"])
        trim()

    return coded(text)


def decode(ids: Column, get) -> Column:
    """Decoded text of each array of ids; a null array gives the empty text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = get()
        for rows in batches:
            yield pd.Series(["" if x is None else own.decode(list(x)) for x in rows])

    return decoded(ids)
