"""Sharding by extendible hashing, with DataFrame functions only.

A document's hash is a string of bits; the directory maps prefixes of it to shards.  All start
in the shard of the empty prefix; a shard above the byte limit, and only such a one, splits on
the next bit.  As a prefix never holds more than its own prefixes do, a document's shard is the
shortest prefix of its hash that fits.  Bytes are summed per prefix of :data:`STEP` more bits at
a time, before anything is shuffled, so a round moves counts, not documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from debtscope.llm.common import saved

#: Most bytes of text in a shard of the registered query.
LIMIT = 1 << 20
#: Bits that one round looks ahead, and bits of the hash.
STEP, BITS = 10, 60


def hash_bits(key: Column) -> Column:
    """The leading :data:`BITS` bits of a key's MD5 as text; a null key hashes as the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4)
    return F.lpad(F.conv(digits, 16, 2), BITS, "0")


def directory(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Shards as (``shard``, ``depth``, ``shard_bytes``) from rows of ``bits`` and ``bytes``.

    Only prefixes of oversized shards are looked at in a further round.  Equal hashes cannot be
    parted by bits: such a group, or one document above the limit, is a shard at full depth that
    :func:`shards` pages.
    """
    pending, done, depth = sizes.select("bits", "bytes"), None, 0
    while True:
        ahead = min(STEP, BITS - depth)
        cells = pending.groupBy(F.substring("bits", 1, depth + ahead).alias("cell")).agg(F.sum("bytes").alias("own"))
        # a cell and its up to STEP prefixes; at most 2^STEP cells share the prefix they split from
        fits = None
        for bits in range(depth, depth + ahead + 1):
            cells = cells.withColumn(f"at{bits}", F.sum("own").over(Window.partitionBy(F.substring("cell", 1, bits))))
            small = F.when(F.col(f"at{bits}") <= limit, F.struct(F.lit(bits).cast("long").alias("depth"), F.col(f"at{bits}").alias("shard_bytes")))
            fits = small if fits is None else F.coalesce(fits, small)
        last = depth + ahead
        if last == BITS:
            fits = F.coalesce(fits, F.struct(F.lit(BITS).cast("long").alias("depth"), F.col(f"at{BITS}").alias("shard_bytes")))
        cells = saved(cells.select("cell", fits.alias("fit")))
        found = cells.filter("fit is not null").select(
            F.expr("substring(cell, 1, fit.depth)").alias("shard"), "fit.depth", "fit.shard_bytes"
        ).distinct()
        done = found if done is None else done.unionByName(found)
        over = cells.filter("fit is null").select(F.col("cell").alias("over"))
        if last == BITS or over.isEmpty():
            return done
        pending = saved(pending.join(over, F.substring("bits", 1, last) == F.col("over"), "left_semi"))
        depth = last


def _prefixes(found: DataFrame) -> Column:
    """All prefixes of ``bits`` that are as long as one of the directory's; exactly one of them is in it."""
    depths = [r["depth"] for r in found.select("depth").distinct().collect()]  # at most BITS + 1 numbers
    return F.array(*[F.substring("bits", 1, d) for d in sorted(depths)]) if depths else F.array(F.lit(""))


def _paged(placed: DataFrame, limit: int) -> DataFrame:
    """Add ``page``: 0 in a shard within the limit; one above it is cut into pages.

    A row of more than half the limit is a page of its own.  The others follow, a page taking those
    that end within the same half limit of their running size, which with the part of the first
    one that reaches back is a limit at most.  The rows of one input partition are numbered on
    their own, then the partitions are put in line.
    """
    fitting = placed.filter(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    half = max(1, limit // 2)
    over = saved(placed.filter(F.col("shard_bytes") > limit).withColumn("__row", F.monotonically_increasing_id()))
    over = over.withColumn("__part", F.shiftright("__row", 33))
    large = F.col("bytes") > half
    small_bytes, number = F.when(large, 0).otherwise(F.col("bytes")), large.cast("long")
    local = Window.partitionBy("shard", "__part").orderBy("__row")
    sums = over.groupBy("shard", "__part").agg(F.sum(small_bytes).alias("part_bytes"), F.sum(number).alias("part_large"))
    whole = Window.partitionBy("shard")  # a row for each input partition
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "shard",
        "__part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("part_large").over(before), F.lit(0)).alias("__large_before"),
        F.sum("part_large").over(whole).alias("__large"),
    )
    counted = over.withColumns({"__bytes": F.sum(small_bytes).over(local), "__number": F.sum(number).over(local)}).join(sums, ["shard", "__part"])
    ends = F.greatest(F.col("__bytes") + F.col("__bytes_before") - 1, F.lit(0))
    page = F.when(large, F.col("__number") + F.col("__large_before") - 1).otherwise(F.col("__large") + F.floor(ends / half))
    return fitting.unionByName(counted.withColumn("page", page).select(fitting.columns))


def shards(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: ``doc_id``, ``bytes`` of its text, ``shard`` (bits), ``depth``, ``page``, ``shard_bytes``.

    A null or empty text has 0 bytes.  Repeated rows with one key go to one shard; where they
    exceed the limit together, the shard is cut into pages within the limit (``page`` from 0), and
    a single document above the limit fills a page of its own.  An empty table gives no rows.
    """
    rows = documents.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), hash_bits(F.col("doc_id")).alias("bits")
    )
    rows = saved(rows)
    found = saved(directory(rows, limit))
    placed = rows.withColumn("shard", F.explode(_prefixes(found))).join(found, "shard")
    return _paged(placed, limit).select("doc_id", "bytes", "shard", "depth", "page", "shard_bytes")


def write(documents: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write all rows, with all columns but ones named ``shard`` or ``page``, as one Parquet folder per shard and page, each from one task.

    Rows are placed by the hash of their key, so rows without a key and repeated rows are written
    like others; texts are shuffled to the directory once and to their folders once.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns if c not in ("shard", "page")]
    rows = documents.select(
        F.struct(*columns).alias("__row_columns"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), hash_bits(F.col("doc_id")).alias("bits")
    )
    found = saved(directory(saved(rows.select("bits", "bytes")), limit))
    hashes = rows.select("bits").distinct().withColumn("shard", F.explode(_prefixes(found))).join(found, "shard")
    placed = _paged(rows.join(saved(hashes.select("bits", "shard", "shard_bytes")), "bits"), limit)
    placed.repartition("shard", "page").select("__row_columns.*", "shard", "page").write.partitionBy("shard", "page").parquet(path)


#: DuckDB SQL of the registered query; depths beyond 40 bits do not occur while keys differ.
ORACLE = f"""
WITH RECURSIVE h AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         substr(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT::BIT::VARCHAR, 5, {BITS}) AS bits
  FROM documents
), sizes AS (
  SELECT substr(bits, 1, d) AS shard, d AS depth, sum(bytes)::BIGINT AS shard_bytes
  FROM h, range(0, 41) AS r(d) GROUP BY ALL
), fits AS (
  SELECT doc_id, bytes, arg_min(shard, depth) AS shard, min(depth) AS depth, arg_min(shard_bytes, depth) AS shard_bytes
  FROM h JOIN sizes ON shard = substr(bits, 1, depth) AND shard_bytes <= {LIMIT} GROUP BY doc_id, bytes, bits
)
SELECT doc_id, bytes, shard, depth::BIGINT AS depth, 0::BIGINT AS page, shard_bytes FROM fits
"""
