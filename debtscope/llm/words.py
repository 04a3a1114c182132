"""Words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text that are expanded into arrays of numbers at once.
PORTION = 1 << 18

#: Places of a word whose letters are looked up in a table; later ones are computed.
_TABLED = 48

#: ASCII letters and digits and everything beyond ASCII.
ALPHANUMERIC = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
#: Everything but blanks and line ends.
UNSPACED = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, each mixed so that every bit depends on all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """A random number for each place and letter."""
    return mixed((place.astype(np.uint64) * np.uint64(256) + letter.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_TABLE = _letters(np.repeat(np.arange(_TABLED), 256), np.tile(np.arange(256), _TABLED))


def portions(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Consecutive texts, together at most :data:`PORTION` characters; a longer text stands alone, null counts as empty."""
    own, size = [], 0
    for text in texts:
        text = text or ""
        if own and size + len(text) > PORTION:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


def word_hashes(texts: list[str], members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each text.

    A-Z are lower-cased; words are runs of the bytes that ``members`` holds, a blank is none.  A
    hash is the sum of a random number for each letter and its place, mixed with the length, so no
    pattern of letters makes different words agree.  Only a portion of the letters is held as
    numbers at once.
    """
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    found += [_hashes(own, members) for own in portions(texts)]
    return np.concatenate([words for words, _ in found]), np.concatenate([counts for _, counts in found])


def _hashes(texts: list[str], members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_hashes` of one portion of texts, or of one longer text."""
    data = [text.encode("utf-8") for text in texts]
    raw = _LOWER[np.frombuffer(b" ".join(data) + b" ", np.uint8)]
    inside = members[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts = np.diff(np.searchsorted(starts, np.cumsum([len(x) + 1 for x in data])), prepend=0)
    size, letters = ends - starts, raw[inside]
    del raw, inside, edge, ends
    first = np.cumsum(size) - size
    sums = np.zeros(len(starts), np.uint64)
    for low in range(0, len(letters), PORTION):
        high = min(low + PORTION, len(letters))
        # the words with letters in this stretch; the first and the last may reach over it
        own = slice(np.searchsorted(first, low, side="right") - 1, np.searchsorted(first, high))
        begin = np.maximum(first[own], low)
        n = np.minimum(first[own] + size[own], high) - begin
        place = np.arange(low, high) - np.repeat(first[own], n)
        letter = letters[low:high]
        far = np.flatnonzero(place >= _TABLED)
        values = _TABLE[np.minimum(place, _TABLED - 1) * 256 + letter]
        values[far] = _letters(place[far], letter[far])
        sums[own] += np.add.reduceat(values, begin - low)
    return mixed(sums + size.astype(np.uint64)), counts
