"""N-gram Jaccard join by a token-group matrix, and the components of its links.

Documents are sets of hashed five-word shingles; equal sets are one node.  Two sets that are
similar enough share a token among the rarest of each of them, so only those rare tokens enter
the matrix.

* Groups: nodes that share rare tokens are compared with one leader per token, chosen anew each
  round; verified links make groups, whose members are all connected already.
* Matrix: the union of a group's rare tokens, as rows (token, group), beside a bit sketch of the
  union of its whole sets.  A second sketch, of odd counts, bounds how alike two nodes can be.
* Queries: a node that shares a token with another group bounds its overlap with the unions of
  that group's parts by the sketch; only qualifying parts are opened, and their members are
  verified exactly.  Of two groups the smaller one asks.

No pair inside a group is looked at again, so groups of many near copies cost no pairs, and no
link between groups is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from debtscope.llm.common import saved, trim
from debtscope.llm.links import components
from debtscope.llm.words import UNSPACED, portions, word_hashes

#: Words of a shingle, and the similarity in hundredths from which on two sets are linked.
WIDTH, PERCENT = 5, 80
#: Counters of the token histogram that orders tokens from rare to frequent: one for so many bytes of text, within bounds.
#: A counter is one byte that stops at 255; with the upper bound they are 32 MB.
BYTES_PER_COUNTER, LEAST_COUNTERS, MOST_COUNTERS = 64, 1 << 16, 1 << 25
#: Counters that travel as one row.
COUNTER_BLOCK = 1 << 16
#: Longs of the two bit sketches of a set: which counters its tokens meet, and which they meet an odd number of times.
SKETCH, ODD = 32, 32
#: Members of a group whose union is looked at together, on average.
GROUP = 8
#: Most keys that are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: Rounds of comparing with leaders before the matrix is built.
ROUNDS = 2

_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence where it is shorter, none without words."""
    words, counts = word_hashes(texts, UNSPACED)
    code = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for i in range(WIDTH):
        code = (code ^ words[i : len(words) - WIDTH + 1 + i]) * _MIX
        code ^= code >> np.uint64(29)
    out, end = [], 0
    for n in counts:
        start, end = end, end + n
        if n >= WIDTH:
            out.append(np.unique(code[start : end - WIDTH + 1]))
        elif n:
            short = np.uint64(n)
            for word in words[start:end]:
                short = np.uint64((int(short ^ word) * int(_MIX)) & 0xFFFFFFFFFFFFFFFF)
                short ^= short >> np.uint64(29)
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_key(tokens: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n):
    """Smallest overlap that a set of ``n`` tokens has with any similar set."""
    return (PERCENT * n + 99) // 100


def _batches(frame: DataFrame, of, schema: str) -> DataFrame:
    return frame.mapInPandas(of, schema)


def _counter(tokens: np.ndarray, counters: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - (counters - 1).bit_length())).astype(np.int64)


def histogram(texts: DataFrame) -> np.ndarray:
    """Number of tokens per counter over all texts, up to 255; each task sums its own first.

    The order it gives only decides how fast rare tokens are found: any order finds all links.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (size // BYTES_PER_COUNTER).bit_length()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()  # what earlier stages have left in this worker
        total = np.zeros(counters, np.uint8)
        for batch in batches:
            for texts in portions(batch["text"]):
                at, n = np.unique(_counter(np.concatenate(shingle_sets(texts)), counters), return_counts=True)
                total[at] = np.minimum(255, total[at].astype(np.int64) + n)
        for block in range(counters // COUNTER_BLOCK):
            part = total[block * COUNTER_BLOCK : (block + 1) * COUNTER_BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [block], "counts": [zlib.compress(part.tobytes(), 1)]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch["block"], batch["counts"]):
                own = np.frombuffer(zlib.decompress(counts), np.uint8).astype(np.uint16)
                sums[block] = np.minimum(255, sums[block] + own) if block in sums else own
        for block, own in sums.items():
            yield pd.DataFrame({"block": [block], "counts": [own.astype(np.uint8).tobytes()]})

    parts = _batches(texts.select("text"), count, "block int, counts binary")
    out = np.zeros(counters, np.uint8)
    merged = _batches(parts.repartition(counters // COUNTER_BLOCK, "block"), merge, "block int, counts binary")
    for row in merged.collect():  # one byte per counter
        out[row["block"] * COUNTER_BLOCK : (row["block"] + 1) * COUNTER_BLOCK] = np.frombuffer(row["counts"], np.uint8)
    return out


def node_rows(documents: DataFrame, counts) -> DataFrame:
    """``doc_id``, ``place`` (where the text is found again), ``whole`` (hash of the text), ``n``, ``k`` and the set's rare tokens.

    A set that occurs again in the same task leaves out its tokens the second time.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for tokens in shingle_sets([x or "" for x in batch["text"]]):
                n, rare, bits, odd = len(tokens), None, None, None
                k = node_key(tokens) if n else None
                if n and k not in seen:
                    seen.add(k)
                    order = np.argsort(counts.value[_counter(tokens, len(counts.value))], kind="stable")
                    rare = tokens[order[: n - least_overlap(n) + 1]].view(np.int64)
                    bits, odd = sketches(tokens)
                out.append((n, k, rare, bits, odd))
            frame = batch[["doc_id", "place", "whole"]].copy()
            frame["n"] = [x[0] for x in out]
            for i, name in enumerate(("rare", "bits", "odd"), 2):
                frame[name] = [x[i] for x in out]
            frame["k"] = pd.array([x[1] for x in out], dtype="Int64")
            yield frame
        trim()

    rows = documents.select("doc_id", _place().alias("place"), F.xxhash64("text").alias("whole"), "text")
    return _batches(rows, build, "doc_id long, place long, whole long, n long, k long, rare array<long>, bits array<long>, odd array<long>")


def _place() -> Column:
    """A document's key, or a hash of its text where it has none."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text"))


def sketches(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters that a set's tokens meet, and counters that they meet an odd number of times, as bits of longs."""
    met = np.bincount((tokens & np.uint64(SKETCH * 64 - 1)).astype(np.int64), minlength=SKETCH * 64) > 0
    odd = np.bincount(((tokens >> np.uint64(16)) & np.uint64(ODD * 64 - 1)).astype(np.int64), minlength=ODD * 64) & 1
    return tuple(np.packbits(x.astype(np.uint8), bitorder="little").view(np.int64) for x in (met, odd))


def node_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``k`` and ``tokens`` of the nodes in ``wanted`` (``k``, ``place``); only their texts are read again."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, tokens in zip(batch["k"], shingle_sets([x or "" for x in batch["text"]])):
                if len(tokens) and node_key(tokens) == k:
                    out.append((k, tokens.view(np.int64)))
            yield pd.DataFrame(out, columns=["k", "tokens"])

    if wanted.count() <= BROADCAST_KEYS:  # two numbers each
        wanted = F.broadcast(wanted)
    rows = documents.select(_place().alias("place"), "text").join(wanted, "place")
    return _batches(rows.select("k", "text"), build, "k long, tokens array<long>").dropDuplicates(["k"])


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose odd counters do not rule out a link.

    Two sets differ in at least as many tokens as counters differ, and linked sets differ in at
    most a ninth of their tokens (for 80 %: 2 / 18).
    """
    left = nodes.select(F.col("k").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a"))
    right = nodes.select(F.col("k").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b"))
    differ = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    fits = (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("n_a") + F.col("n_b"))
    return pairs.join(left, "a").join(right, "b").filter(fits).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough, by their exact overlap."""
    left = sets.select(F.col("k").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("k").alias("b"), F.col("tokens").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.withColumn("overlap", F.size(F.array_intersect("left", "right")))
    union = F.size("left") + F.size("right") - F.col("overlap")
    return both.filter(100 * F.col("overlap") >= PERCENT * union).select("a", "b")


def _alike(n: str, m: str) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return (100 * F.col(n) >= PERCENT * F.col(m)) & (100 * F.col(m) >= PERCENT * F.col(n))


def _slack(n: Column, place: Column) -> Column:
    """What a token at this place leaves for a link: the first token that two linked sets share has at least
    ``PERCENT`` times the other set's size, on both sides, as all that they share stands from there on."""
    return (100 + PERCENT) * (n - place) - PERCENT * n


def _leaders(matrix: DataFrame, number: int) -> DataFrame:
    """For each node one candidate in another group: the leader it shares most rare tokens with.

    In the first round the node with the fewest tokens of its own leads, as a text that copies were made from does.
    """
    turn = F.xxhash64("k", F.lit(number))
    turn = F.struct(F.col("own") if number == 0 else F.lit(0).cast("long"), turn)
    first = F.min(F.struct(turn.alias("turn"), "k", "n", "comp")).alias("leader")
    lead = matrix.groupBy("token").agg(first).select("token", F.col("leader.k").alias("b"), F.col("leader.n").alias("m"), F.col("leader.comp").alias("other"))
    pairs = matrix.join(lead, "token").filter((F.col("comp") != F.col("other")) & _alike("n", "m"))
    pairs = pairs.groupBy(F.col("k").alias("a"), "b").agg(F.count("*").alias("times"))
    return pairs.groupBy("a").agg(F.max(F.struct("times", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _queries(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes in different groups that may be similar, found through the token-group matrix.

    A group is asked as a whole first; its members are then parted so that the union of a part
    stays tight, and only the parts whose bound reaches the query are opened.  Of an opened part
    those members are met that share a token which can be the first shared one of both.
    """
    met = [F.col("bits")[i].alias(f"s{i}") for i in range(SKETCH)]
    members = saved(matrix.select("k", "n", "comp").distinct())
    groups = members.groupBy("comp").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"))
    groups = saved(groups)
    asking = matrix.join(groups.select("comp", "size"), "comp")
    tokens = matrix.groupBy("token", F.col("comp").alias("group"))  # the unions of the groups
    tokens = tokens.agg(F.max("slack").alias("other_slack"), F.min("n").alias("other_least"))
    named = groups.select(F.col("comp").alias("group"), F.col("size").alias("other_size"), "least", "most")
    smaller = F.struct("size", "comp") < F.struct("other_size", "group")
    fits = (100 * F.col("n") >= PERCENT * F.col("least")) & (100 * F.col("most") >= PERCENT * F.col("n"))
    may_be_first = (F.col("slack") >= PERCENT * F.col("other_least")) & (F.col("other_slack") >= PERCENT * F.col("n"))
    by_token = asking.join(tokens.join(named, "group"), "token").filter(smaller & fits & may_be_first)
    by_token = saved(by_token.select("token", "k", "n", "slack", "group"))
    asked = by_token.select("k", "n", "group").distinct()

    part = F.pmod(F.xxhash64("k"), F.ceil(F.col("size") / GROUP))
    parted = saved(members.join(groups.select("comp", "size"), "comp").select("k", F.col("n").alias("m"), F.col("comp").alias("group"), part.alias("part")))
    unions = parted.join(nodes.select("k", *met), "k").groupBy("group", "part")
    unions = unions.agg(F.min("m").alias("least"), F.max("m").alias("most"), *[F.bit_or(f"s{i}").alias(f"u{i}") for i in range(SKETCH)])
    bound = asked.join(nodes.select("k", *met), "k").join(unions, "group").filter(fits)
    missing = sum((F.bit_count(F.col(f"s{i}").bitwiseAND(F.bitwise_not(f"u{i}"))) for i in range(SKETCH)), F.lit(0))
    # a link with m tokens needs an overlap of 80 / 180 of n + m
    reaches = (100 + PERCENT) * (F.col("n") - missing) >= PERCENT * (F.col("n") + F.col("least"))
    opened = bound.filter(reaches).select(F.col("k").alias("a"), "group", "part")
    members = matrix.select("token", F.col("k").alias("b"), F.col("n").alias("m"), F.col("comp").alias("group"), F.col("slack").alias("other_slack"))
    both_first = (F.col("slack") >= PERCENT * F.col("m")) & (F.col("other_slack") >= PERCENT * F.col("n"))
    met = by_token.withColumnRenamed("k", "a").join(members, ["token", "group"]).filter(_alike("n", "m") & both_first)
    met = met.select("a", "b", "group").distinct().join(parted.select(F.col("k").alias("b"), "part"), "b")
    return met.join(opened, ["a", "group", "part"], "left_semi").select("a", "b")


def linked(documents: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``k`` (its set), ``component_id`` (smallest key reachable, itself
    included), and with ``place`` and ``whole`` where it is found again, ``head`` the same of its component's first document.

    Two documents are linked when their shingle sets have at least 80 % of their union in
    common.  Documents without words are empty, have a null ``k`` and are linked with nothing.
    Repeated rows and repeated keys are documents of their own; a component's key is null only
    where all its keys are.  No rows give no rows.
    """
    documents = documents.select("doc_id", "text")
    counts = documents.sparkSession.sparkContext.broadcast(histogram(documents))  # at most MOST_COUNTERS bytes
    rows = saved(node_rows(documents, counts))
    once = rows.filter("rare is not null").dropDuplicates(["k"])
    tokens = once.select("k", "n", F.size("rare").cast("long").alias("rare"), F.posexplode("rare").alias("place_in_order", "token"))
    tokens = tokens.select("k", "n", "rare", "token", _slack(F.col("n"), F.col("place_in_order")).alias("slack"))
    several = tokens.groupBy("token").agg(F.count("*").alias("nodes")).filter("nodes > 1").select("token")
    tokens = tokens.join(several, "token")
    own = F.col("rare") - F.count("*").over(Window.partitionBy("k"))  # the rare tokens of one set
    tokens = saved(tokens.withColumn("own", own).drop("rare"))
    keyed = F.struct(F.col("doc_id").isNull().alias("last"), "place", "whole")
    nodes = rows.filter("k is not null").groupBy("k").agg(F.min("place").alias("place"), F.min(keyed).alias("first"))
    shared = rows.filter("rare is not null").join(tokens.select("k").distinct(), "k", "left_semi")
    shared = saved(shared.select("k", "n", "bits", "odd").dropDuplicates(["k"]))

    edges, groups = None, None
    for number in range(ROUNDS + 1):
        matrix = tokens.withColumn("comp", F.col("k"))
        if groups is not None:
            matrix = tokens.join(groups, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
        matrix = saved(matrix) if number == ROUNDS else matrix
        pairs = _leaders(matrix, number) if number < ROUNDS else _queries(matrix, shared)
        pairs = saved(plausible(pairs, shared))
        wanted = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
        sets = saved(node_sets(documents, nodes.select("k", "place").join(wanted, "k")))
        found = saved(verified(pairs, sets))
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.unionByName(found)
        groups = components(edges)
    # the first document of each group of nodes
    named = nodes.select("k", "first")
    if groups is not None:
        named = named.join(groups, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
        least = named.groupBy("comp").agg(F.min("first").alias("head"))
        named = named.join(least, "comp").select("k", "head")
    else:
        named = named.select("k", F.col("first").alias("head"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "k", "place", "whole").join(named, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("doc_id")).when(~F.col("head.last"), F.col("head.place"))
    return out.select("doc_id", "n_shingles", "k", component.alias("component_id"), "place", "whole", "head")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest key, with all its columns.

    Of repeated rows one stays; documents without words all stay.
    """
    own = linked(documents).filter((F.col("place") == F.col("head.place")) & (F.col("whole") == F.col("head.whole")))
    own = saved(own.groupBy(F.col("place").alias("__place"), F.col("whole").alias("__whole")).count())
    marked = documents.withColumns({"__place": _place(), "__whole": F.xxhash64("text"), "__words": F.col("text").rlike(r"[^\x20\x09-\x0D]")})
    worded = marked.filter("__words")
    few = own.count() <= BROADCAST_KEYS  # three numbers each

    def picked(keys: DataFrame) -> DataFrame:
        keys = keys.drop("count")
        return worded.join(F.broadcast(keys) if few else keys, ["__place", "__whole"], "left_semi")

    # only repeated rows have to meet
    first = F.row_number().over(Window.partitionBy("__place", "__whole").orderBy("__place"))
    repeated = picked(own.filter("count > 1")).withColumn("__first", first).filter("__first = 1")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    stay = picked(own.filter("count = 1")).select(columns).unionByName(repeated.select(columns))
    return stay.unionByName(marked.filter(~F.coalesce("__words", F.lit(False))).select(columns))
