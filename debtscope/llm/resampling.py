"""Importance resampling towards a target: hashed n-gram weights, Gumbel noise and a distributed quickselect.

Texts are bags of hashed runs of one or two words.  The gain of a bucket says how much more often
it occurs in the target's texts than in the documents; an array of all gains scores a document
by their mean.  With Gumbel noise on the score, the k highest scores are a sample drawn without
replacement in proportion to the weights.

The k-th highest key is found without a sort: random pivots, exact counts of the keys below, at
and above each of them, and the same again between the two pivots that enclose it.  Only the
rows from there on are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from debtscope.llm.common import saved
from debtscope.llm.ranks import numbered
from debtscope.llm.words import ALPHANUMERIC, _LOWER

#: Buckets of the hashed features.
BUCKETS = 10_000
#: Fewest words of a document that may be drawn, share drawn in hundredths, and the noise's seed.
LEAST_WORDS, SHARE, SEED = 20, 25, 7
#: Pivots of one round of the quickselect.
PIVOTS = 24
#: Bytes of text that are looked at together.
PIECE = 1 << 22
#: Words of more bytes take the scalar checksum.
LONG = 24

_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """CRC-32 of one byte, reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1)).astype(np.uint32)
    return table


_TABLE = _byte_table()


def _zeros(state: np.ndarray) -> np.ndarray:
    """The state after one more zero byte."""
    return _TABLE[state & np.uint32(255)] ^ (state >> np.uint32(8))


def _shift_tables() -> np.ndarray:
    """For 0 to LONG zero bytes and each byte of a checksum, what they make of it; they are linear."""
    own = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    out = [own]
    for _ in range(LONG):
        own = _zeros(own)
        out.append(own)
    return np.array(out)


_SHIFT = _shift_tables()


def word_checksums(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of the words of ``raw``, a byte of all words at a time."""
    clipped = np.minimum(sizes, LONG)
    order = np.argsort(-clipped, kind="stable")
    ordered, size = starts[order], clipped[order]
    ends = np.searchsorted(-size, -np.arange(1, LONG + 1), side="right")  # words of at least so many bytes
    state = np.full(len(order), _ALL, np.uint32)
    for j, n in enumerate(ends):
        if not n:
            break
        state[:n] = _TABLE[(state[:n] ^ raw[ordered[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ _ALL
    for i in np.flatnonzero(sizes > LONG):
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + sizes[i]])
    return out


def pair_checksums(before: np.ndarray, own: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of ``before``, a blank and the word, from the checksums of both."""
    spaced = _TABLE[((before ^ _ALL) ^ np.uint32(32)) & np.uint32(255)] ^ ((before ^ _ALL) >> np.uint32(8)) ^ _ALL
    size = np.minimum(sizes, LONG)
    out = own.copy()
    for k in range(4):
        out ^= _SHIFT[size, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(sizes > LONG):
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + sizes[i]], int(spaced[i]))
    return out


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece the owner (place in ``texts``) of each word, and owner and bucket of each feature.

    A-Z are lower-cased; words are runs of ASCII letters, digits and anything beyond ASCII, and a
    feature is a word or two consecutive words joined by a blank.
    """
    data = [(text or "").encode("utf-8") for text in texts]
    raw = _LOWER[np.frombuffer(b" ".join(data) + b" ", np.uint8)]
    bounds = np.cumsum([len(x) + 1 for x in data])
    at, last, last_owner = 0, np.zeros(1, np.uint32), np.full(1, -1)
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and ALPHANUMERIC[raw[end - 1]]:  # cut behind a byte that no word holds
            ahead = np.flatnonzero(~ALPHANUMERIC[raw[end : end + 4096]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(len(raw), end + 4096)
        edge = np.diff(ALPHANUMERIC[raw[at:end]].astype(np.int8), prepend=0, append=0)
        starts = np.flatnonzero(edge == 1) + at
        sizes = np.flatnonzero(edge == -1) + at - starts
        at = end
        if not len(starts):
            continue
        owner = np.searchsorted(bounds, starts, side="right")
        own = word_checksums(raw, starts, sizes)
        same = np.concatenate([last_owner, owner[:-1]]) == owner
        pair = pair_checksums(np.concatenate([last, own[:-1]])[same], own[same], raw, starts[same], sizes[same])
        last, last_owner = own[-1:], owner[-1:]
        yield owner, np.concatenate([owner, owner[same]]), (np.concatenate([own, pair]) % np.uint32(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Number of features of each bucket over all rows of ``texts`` (``text``); each task sums its own first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, bucket in features(list(batch["text"])):
                total += np.bincount(bucket, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": met, "n": total[met]})

    rows = texts.select("text").filter("text is not null").mapInPandas(count, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row for each bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the logarithm, rounded down, of how much more often a bucket occurs in the target."""
    s, t = float(own.sum()), float(target.sum())
    ratio = lambda i: (float(target[i]) + 1) * (s + BUCKETS) / ((float(own[i]) + 1) * (t + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(i))) for i in range(BUCKETS)], np.int64)


def weigh(text: Column, gain: np.ndarray) -> Column:
    """Struct of ``n_words``, ``n_features`` and ``weight``, the mean gain rounded down; 0 for a text without words."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(texts: pd.Series) -> pd.DataFrame:
        words, number, total = np.zeros((3, len(texts)), np.int64)
        for owner, owners, bucket in features(list(texts)):
            words += np.bincount(owner, minlength=len(texts))
            number += np.bincount(owners, minlength=len(texts))
            total += np.bincount(owners, weights=gain[bucket], minlength=len(texts)).astype(np.int64)
        return pd.DataFrame({"n_words": words, "n_features": number, "weight": total // np.maximum(number, 1)})

    return weighed(text)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise times a thousand, rounded down, from a hash of the key; a null key hashes as the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share)))


def _literal(key) -> Column:
    return F.struct(*[F.lit(value).cast(kind).alias(name) for value, (name, kind) in zip(key, KEY)])


#: A total order of rows, highest score first: the composite key's parts.
KEY = (("down", "long"), ("keyless", "int"), ("key", "long"), ("at", "long"))


def kth(keys: DataFrame, k: int) -> tuple:
    """The k-th smallest (from 1) of the distinct keys ``key`` (structs of :data:`KEY`), by a distributed quickselect."""
    low, high, passed, turn = None, None, 0, 0
    while True:
        open_ = keys
        if low is not None:
            open_ = open_.filter(F.col("key") > _literal(low))
        if high is not None:
            open_ = open_.filter(F.col("key") < _literal(high))
        chosen = open_.orderBy(F.xxhash64("key.key", "key.at", F.lit(turn)), "key").limit(PIVOTS).collect()
        pivots = sorted({tuple(r["key"]) for r in chosen})
        if not pivots:
            raise ValueError(f"there is no key number {k}")
        counts = [
            (F.count(F.when(F.col("key") < _literal(p), 1)).alias(f"b{i}"), F.count(F.when(F.col("key") == _literal(p), 1)).alias(f"e{i}"))
            for i, p in enumerate(pivots)
        ]
        found, turn, own_low, own_high, below = open_.agg(*[c for pair in counts for c in pair]).first(), turn + 1, low, high, 0
        for i, pivot in enumerate(pivots):
            less, equal = found[f"b{i}"], found[f"e{i}"]
            if passed + less < k <= passed + less + equal:
                return pivot
            if k <= passed + less:
                own_high = pivot
                break
            own_low, below = pivot, less + equal
        low, high, passed = own_low, own_high, passed + below


def resample(documents: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (from 1; null where not drawn).

    Of the documents with at least ``least_words`` words the ``share`` hundredths with the highest
    score are drawn, rounded down; ties go to the smaller key, rows without a key come last, and
    of equal rows any may be drawn.  Null texts have no words; where nothing may be drawn, no row
    has a rank, and no rows give no rows.
    """
    gain = gains(bucket_counts(documents), bucket_counts(target))
    rows = documents.select("doc_id", weigh(F.col("text"), gain).alias("w")).select("doc_id", "w.*")
    rows = saved(rows.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "at": F.monotonically_increasing_id()}))
    keyless, key = F.col("doc_id").isNull().cast("int"), F.coalesce("doc_id", F.lit(0))
    keyed = rows.withColumn("key", F.struct((-F.col("score")).alias("down"), keyless.alias("keyless"), key.alias("key"), "at"))
    fit = keyed.filter(F.col("n_words") >= least_words)
    k = share * fit.count() // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = _literal(kth(fit.select("key"), k))
    won = (F.col("n_words") >= least_words) & (F.col("key") <= last)
    winners = numbered(keyed.filter(won), [], [F.col("key")])
    winners = winners.select(*columns, (F.col("place") + 1).alias("rank"))
    return winners.unionByName(keyed.filter(~won).select(*columns, F.lit(None).cast("long").alias("rank")))


#: CRC-32 in DuckDB: a byte is mixed in, then eight bits are shifted out.
CRC32 = """list_reduce(flatten(list_transform(range(1, octet_length(encode({0})) + 1),
        lambda i: [('0x' || substr(hex(encode({0})), (2 * i - 1)::BIGINT, 2))::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256])),
        lambda s, e: CASE WHEN e < 256 THEN xor(s, e) ELSE xor(s >> 1, 3988292384 * (s & 1)) END, 4294967295::BIGINT)"""

#: DuckDB SQL of the registered query.
ORACLE = f"""
WITH texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark
), listed AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), '{"".join(map(chr, range(65, 91)))}', '{"".join(map(chr, range(97, 123)))}'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts
), runs AS (
  SELECT kind, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM listed
), hashed AS (
  SELECT feature, xor({CRC32.format("feature")}, 4294967295::BIGINT) % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM runs)
), counted AS (
  SELECT kind, id, bucket, count(*) AS n FROM runs JOIN hashed USING (feature) GROUP BY ALL
), gained AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (tt + {BUCKETS}) / ((s + 1)::DOUBLE * (ss + {BUCKETS}))))::BIGINT AS gain
  FROM (SELECT bucket, sum(CASE kind WHEN 'd' THEN n ELSE 0 END) AS s, sum(CASE kind WHEN 'b' THEN n ELSE 0 END) AS t FROM counted GROUP BY bucket),
       (SELECT sum(CASE kind WHEN 'd' THEN n ELSE 0 END)::DOUBLE AS tt, sum(CASE kind WHEN 'b' THEN n ELSE 0 END)::DOUBLE AS ss FROM counted)
), weighed AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM counted JOIN gained USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT doc_id, row_number() OVER () AS id FROM documents) d JOIN listed l ON l.id = d.id AND l.kind = 'd' LEFT JOIN weighed w ON w.id = d.id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS fit FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {SHARE} * fit // 100 THEN place END AS rank FROM placed
"""
