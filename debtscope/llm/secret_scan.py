"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as O, B (a secret begins) or I (inside one) from a token's shape or word,
its neighbours' and features of the file.  It learns from the patterns' hits in a bounded sample
of the documents and so also finds values in like places that the patterns miss.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from debtscope.llm.common import saved, trim

# --- fixed values: base patterns, in the order of their kinds --------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_24 = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# ---------------------------------------------------------------------------------------------

#: Most documents that the field is trained on, characters around a hit, windows per document.
MAX_ROWS, AROUND, WINDOWS = 1200, 120, 3
#: Words with a class of their own; all other tokens share the class of their shape.
WORDS = 256

TOKEN = re.compile(r"\w+|[^\w\s]")
_DIGIT = re.compile(r"\d")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
_SHAPES = 8 * 8 * 2 + len(_MARKS) + 1
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Hits of the fixed patterns as (start, kind, end), each kind leftmost and non-overlapping; hits that are too short are dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of 24 or more is the whole run: what stands before it is no hex digit
    out += [(m.start(), 2, m.end()) for m in HEX_24.finditer(text)]
    return sorted(out)


def values(text: str) -> list[tuple[int, int]]:
    """Where the values of the hits stand; what the field learns to find."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(a, b) for a, kind, b in base_spans(text) if kind]
    return out


def shape(token: str) -> int:
    """Form of a token: kinds of its characters, whether all are hex digits, length step; marks stand for themselves."""
    first = token[0]
    if not (first.isalnum() or first == "_"):
        return 128 + (_MARKS.find(first) + 1)
    if token.isalpha():
        kinds = 1 if token.islower() else 2 if token.isupper() else 3
    else:
        kinds = (token != token.upper()) + 2 * (token != token.lower()) + 4 * (_DIGIT.search(token) is not None)
    length = bisect_right((2, 4, 8, 12, 16, 24, 40), len(token))
    return kinds * 16 + length * 2 + (HEX.fullmatch(token) is not None)


def file_features(text: str) -> int:
    """Class of a whole text: whether it has lines of assignments or quotes, and a length step."""
    return (2 * ("=" in text) + ('"' in text)) * 4 + min(3, len(text).bit_length() // 5)


@dataclass(frozen=True)
class Field:
    """Words with own classes, and scores per class and tag for the token, its neighbours, the file and tag pairs."""

    words: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    before2: np.ndarray
    after: np.ndarray
    file: np.ndarray
    pairs: np.ndarray

    @cached_property
    def leads(self) -> dict[str, np.ndarray]:
        """By how much O leads in each score at least; their sum never exceeds the lead of the summed scores."""
        return {k: t[:, O] - np.maximum(t[:, B], t[:, I]) for k in ("own", "before", "before2", "after", "file") for t in [getattr(self, k)]}

    def sure(self) -> float:
        """A token whose O score leads by more than this is O on the best path, whatever its neighbours are."""
        return 2.0 * float(self.pairs.max() - self.pairs.min())


class _Classes(dict):
    """Stretch without white space to the classes of its tokens; emptied when it has grown large."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self._words = words

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        found = tuple([self._words.get(t.lower(), WORDS + shape(t)) for t in TOKEN.findall(stretch)])
        if len(stretch) < 64:
            self[stretch] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """Classes of a text's tokens, in order."""
        return np.fromiter(chain.from_iterable(map(self.__getitem__, text.split())), np.int64)


def _scores(field: Field, classes: np.ndarray, file: int) -> np.ndarray:
    """Score of each tag at each token."""
    out = field.own[classes] + field.file[file]
    out[1:] += field.before[classes[:-1]]
    out[2:] += field.before2[classes[:-2]]
    out[:-1] += field.after[classes[1:]]
    return out


def viterbi(scores: np.ndarray, pairs: np.ndarray, edges: bool = True) -> list[int]:
    """Best tag sequence; with ``edges`` the tokens before and behind it are O."""
    best = scores[0] + (pairs[O] if edges else 0.0)
    back = []
    for now in scores[1:]:
        step = best[:, None] + pairs
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + now
    tags = [int((best + (pairs[:, O] if edges else 0.0)).argmax())]
    for row in reversed(back):
        tags.append(int(row[tags[-1]]))
    return tags[::-1]


def tagged_spans(text: str, field: Field, classes: _Classes) -> list[tuple[int, int]]:
    """Spans of the best tag sequence of a whole text.

    Tokens that are O on any best path split the text; only the stretches between them need the
    dynamic programme, so the result is that of decoding the whole text at once.
    """
    own = classes.of(text)
    if not len(own):
        return []
    lead = field.leads["own"][own] + field.leads["file"][file_features(text)]
    lead[1:] += field.leads["before"][own[:-1]]
    lead[2:] += field.leads["before2"][own[:-2]]
    lead[:-1] += field.leads["after"][own[1:]]
    if lead.min() > field.sure():
        return []
    scores = _scores(field, own, file_features(text))
    open_ = np.flatnonzero(scores[:, O] - np.maximum(scores[:, B], scores[:, I]) <= field.sure())
    if not len(open_):
        return []
    tags = np.zeros(len(own), np.int8)
    for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
        tags[part] = viterbi(scores[part], field.pairs)
    if not tags.any():
        return []
    out: list[tuple[int, int]] = []
    last = O
    for tag, m in zip(tags, TOKEN.finditer(text)):
        if tag == B or (tag == I and last == O):
            out.append(m.span())
        elif tag == I:
            out[-1] = (out[-1][0], m.end())
        last = tag
    return out


# --- training ------------------------------------------------------------------------------


def windows(text: str) -> list[tuple[str, list[tuple[int, int]], int]]:
    """Stretches of a text for training, with the values inside: around the first hits, and one elsewhere."""
    found, out, file = values(text), [], file_features(text)
    starts = [a for a, _ in found[: WINDOWS - 1]] + [len(text) // 3]
    for middle in starts:
        low, high = max(0, middle - AROUND), middle + AROUND
        out.append((text[low:high], [(a - low, b - low) for a, b in found if b > low and a < high], file))
    return out


def _tags(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    tokens, tags = [], []
    for m in TOKEN.finditer(text):
        inside = [a for a, b in spans if a <= m.start() and m.end() <= b]
        tokens.append(m.group())
        tags.append(O if not inside else B if min(inside) == m.start() else I)
    return tokens, tags


def fit(examples: list[tuple[str, list[tuple[int, int]], int]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximise the penalised conditional likelihood by AdaGrad steps over all windows at once.

    Expected counts come from forward and backward sums, run over all windows side by side.
    Without examples every score is zero but for the file classes, which prefer O.
    """
    pairs_of = [(_tags(text, spans), file) for text, spans, file in examples]
    pairs_of = [((tokens, tags), file) for (tokens, tags), file in pairs_of if tokens]
    seen = Counter(t.lower() for (tokens, tags), _ in pairs_of if any(tags) for t in tokens if t[0].isalpha() and t.isalpha())
    words = {w: i for i, (w, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:WORDS]) if n >= 5}
    size, files = WORDS + _SHAPES, 16
    tables = {k: np.zeros((n, 3)) for k, n in (("own", size), ("before", size), ("before2", size), ("after", size), ("file", files), ("pairs", 3))}
    if not pairs_of:
        tables["file"][:, O] = 1.0
        return Field(words, **tables)
    n, width = len(pairs_of), max(len(tokens) for (tokens, _), _ in pairs_of)
    cls, tag, real = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    of = _Classes(words)
    for i, ((tokens, tags), _) in enumerate(pairs_of):
        cls[i, : len(tokens)], tag[i, : len(tokens)], real[i, : len(tokens)] = of.of(" ".join(tokens)), tags, True
    file = np.array([f for _, f in pairs_of])
    squares = {k: np.full_like(v, 1e-8) for k, v in tables.items()}
    truth = np.eye(3)[tag] * real[..., None]
    both = real[:, 1:]
    truth_pairs = np.einsum("nti,ntj->ij", truth[:, :-1] * both[..., None], truth[:, 1:])

    def counts(weight: np.ndarray) -> dict[str, np.ndarray]:
        def by(index: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
            return np.stack([np.bincount(index.ravel(), w[..., k].ravel(), rows) for k in range(3)], axis=1)

        return {
            "own": by(cls, weight, size),
            "before": by(cls[:, :-1], weight[:, 1:], size),
            "before2": by(cls[:, :-2], weight[:, 2:], size),
            "after": by(cls[:, 1:], weight[:, :-1] * both[..., None], size),
            "file": by(np.broadcast_to(file[:, None], cls.shape), weight, files),
        }

    wanted = counts(truth) | {"pairs": truth_pairs}
    for _ in range(rounds):
        e = tables["own"][cls] + tables["file"][file][:, None, :]
        e[:, 1:] += tables["before"][cls[:, :-1]]
        e[:, 2:] += tables["before2"][cls[:, :-2]]
        e[:, :-1] += tables["after"][cls[:, 1:]] * both[..., None]
        trans = np.exp(tables["pairs"])
        x = np.exp(e - e.max(axis=2, keepdims=True)) * real[..., None]
        forward, scale = np.zeros_like(x), np.ones((n, width))
        forward[:, 0] = x[:, 0]
        for t in range(width):
            if t:
                forward[:, t] = (forward[:, t - 1] @ trans) * x[:, t]
            scale[:, t] = np.where(real[:, t], forward[:, t].sum(axis=1), 1.0)
            forward[:, t] /= scale[:, t][:, None]
        backward, expected_pairs = np.ones_like(x), np.zeros((3, 3))
        for t in range(width - 2, -1, -1):
            right = x[:, t + 1] * backward[:, t + 1] / scale[:, t + 1][:, None]
            on = real[:, t + 1]
            backward[:, t] = np.where(on[:, None], right @ trans.T, 1.0)
            expected_pairs += (forward[:, t][on].T @ right[on]) * trans
        share = forward * backward
        share /= np.maximum(share.sum(axis=2, keepdims=True), 1e-12)
        expected = counts(share * real[..., None]) | {"pairs": expected_pairs}
        for k, table in tables.items():
            step = (wanted[k] - expected[k]) / n - decay * table
            squares[k] += step * step
            table += rate * step / np.sqrt(squares[k])
    return Field(words, **{k: v.astype(np.float32) for k, v in tables.items()})


def train(documents: DataFrame, max_rows: int = MAX_ROWS) -> Field:
    """Fit on windows of at most ``max_rows`` documents, chosen by a hash of their key; half of the places go to documents with hits.

    Only keys are sorted, and only windows of bounded length travel to the driver.  Rows without
    key or text are left out, and without any row the field tags nothing.
    """
    rows = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    hit = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    judged = saved(rows.select("doc_id", hit.alias("hit")))
    chosen = None
    for part in (judged.filter("hit"), judged.filter("not hit")):
        part = part.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most max_rows keys; of repeated keys one text is taken
    picked = rows.join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(doc, *w) for doc, text in zip(batch["doc_id"], batch["text"]) for w in windows(text)]
            yield pd.DataFrame(
                {
                    "doc_id": [x[0] for x in out],
                    "part": [x[1] for x in out],
                    "starts": [[a for a, _ in x[2]] for x in out],
                    "ends": [[b for _, b in x[2]] for x in out],
                    "file": [x[3] for x in out],
                }
            )

    got = picked.mapInPandas(extract, "doc_id long, part string, starts array<int>, ends array<int>, file int").toPandas()
    got = got.sort_values(["doc_id", "part"], kind="stable")
    return fit([(p, list(zip(a, b)), int(f)) for p, a, b, f in zip(got["part"], got["starts"], got["ends"], got["file"])])


# --- scanning ------------------------------------------------------------------------------


def scan(text: Column, field: Field) -> Column:
    """Array of structs (``kind``, ``start``, ``end``) of each whole text, by start and kind; null counts as empty.

    Base hits stay as they are; spans of the field that do not lie inside one are added with
    kind ``crf``.  Positions count code points, the end is exclusive.
    """

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classes = _Classes(field.words)
        for texts in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(text or "", field, classes)] for text in texts])
        trim()

    return scanned(text)


def spans_of(text: str, field: Field, classes: _Classes) -> list[tuple[int, int, int]]:
    """Base hits and the field's spans beside them as (start, kind, end), in order."""
    base = base_spans(text)
    more = [(a, 3, b) for a, b in tagged_spans(text, field, classes) if not any(s <= a and b <= e for s, _, e in base)]
    return sorted(base + more)


def without(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with each maximal run of spans (start, end) replaced by ``mark``."""
    parts, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = end
    return "".join(parts) + text[at:]


def cleaned(text: Column, field: Field, mark: str = "[SECRET]") -> Column:
    """:func:`scan` and :func:`redact` in one step: the text without its secrets; null and untouched texts stay."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classes = _Classes(field.words)
        for texts in batches:
            found = [[] if text is None else [(a, b) for a, _, b in spans_of(text, field, classes)] for text in texts]
            yield pd.Series([without(text, own, mark) if own else text for text, own in zip(texts, found)])
        trim()

    return cut(text)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of spans replaced by ``mark``; null and untouched texts stay."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, rows: pd.Series) -> pd.Series:
        untouched = lambda text, found: text is None or found is None or not len(found)
        return pd.Series(
            [t if untouched(t, found) else without(t, [(x["start"], x["end"]) for x in found], mark) for t, found in zip(texts, rows)]
        )

    return cut(text, spans)
