"""Merkle manifest of a table of documents: content-addressed records and proofs by descent.

Each row is a leaf, the SHA-256 of its fields.  The leaves of a source, in order of their keys,
are joined in runs of 16 to nodes, these again, until one subroot is left; the subroots in order
of their sources make the root in the same way.  A record leads from a node's digest to the
digests of its children; records with one digest are one.

A proof is found by walking down from the root: the hexadecimal digits of a source's place and
of a leaf's rank say which child comes next, the other children are collected, and the collected
segments are turned round at the end.  Requests for leaves below one node go down together, so
a node's record is looked up once per level, and a key of any join stands for 16 rows at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from debtscope.llm.common import remainder, saved
from debtscope.llm.ranks import numbered
from debtscope.llm.resampling import CRC32

#: Children of a node: one hexadecimal digit of a rank.
FANOUT, BITS = 16, 4


@dataclass
class Manifest:
    """``leaves`` (``grp``, ``rank``, ``size`` of the source, ``digest``, and the columns of the rows they were built from),
    ``roots`` (``grp``, ``rank``, ``size``, ``height``, ``digest`` of the subroots), ``root`` (``digest``, no row for an empty table), and
    by height the records (``digest``, ``children``) of the sources' trees and of the tree above them."""

    leaves: DataFrame
    roots: DataFrame
    root: DataFrame
    records: list[DataFrame]
    root_records: list[DataFrame]


def field(value: Column) -> Column:
    """A field as a digest reads it: ``-`` for null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def group_of(source: Column) -> Column:
    """A source as a key that is never null and sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def document_leaves(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``grp``, ``digest`` and ``claimed`` of every row.

    ``claimed`` is the digest after the text was tampered with (A-Z lower-cased), where 5 divides
    the CRC-32 of the key; elsewhere, as for rows without a key, it is null.
    """
    key, text = F.col("doc_id"), F.col("text")
    own = lambda text: leaf(key, F.col("source"), F.col("lang"), F.col("n_chars"), text)
    claimed = F.when(remainder(key, 5) == 0, own(lowered(text)))
    return documents.select("doc_id", group_of(F.col("source")).alias("grp"), own(text).alias("digest"), claimed.alias("claimed"))


def _height(size: Column) -> Column:
    """Levels above the leaves of a tree: the hexadecimal digits of its last rank."""
    return F.when(size > 1, F.length(F.hex(size - 1))).otherwise(0)


def _tree(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (``grp``, ``height``, ``digest``) and records by height of the trees of ``leaves`` (``grp``, ``rank``, ``size``, ``digest``)."""
    most = leaves.agg(F.max(_height(F.col("size")))).first()[0] or 0
    level = leaves.select("grp", F.col("rank").alias("at"), _height(F.col("size")).alias("height"), "digest")
    roots, records = level.filter("height = 0"), []
    for height in range(1, most + 1):
        run = level.filter(F.col("height") >= height).groupBy("grp", F.shiftright("at", BITS).alias("up"), "height")
        children = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])  # 16 at most
        level = run.agg(children.alias("children")).withColumn("digest", F.sha2(F.array_join("children", ""), 256))
        level = saved(level.withColumnRenamed("up", "at"))
        records.append(level.groupBy("digest").agg(F.first("children").alias("children")))
        roots = roots.unionByName(level.filter(F.col("height") == height).drop("children"))
    return roots.select("grp", "height", "digest"), records


def manifest(leaves: DataFrame) -> Manifest:
    """Build the trees over rows of ``grp``, ``doc_id``, ``digest`` and more columns.

    In a source rows ascend by key, those without one first; of equal keys the smaller digest
    comes first, and equal rows are leaves of their own.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    ranked = saved(numbered(saved(leaves), ["grp"], order).withColumnRenamed("place", "rank"))
    roots, records = _tree(ranked)
    roots = saved(numbered(roots, [], [F.col("grp")]).withColumnRenamed("place", "rank"))
    top, root_records = _tree(roots.withColumn("grp", F.lit("")).drop("height"))
    return Manifest(ranked, roots, saved(top.select("digest")), records, root_records)


def _segment(children: Column, digit: Column) -> Column:
    """The children left and right of the chosen one, joined."""
    left = F.array_join(F.slice(children, F.lit(1), digit), "")
    right = F.array_join(F.slice(children, digit + 2, F.lit(FANOUT)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _down(state: DataFrame, records: DataFrame, asked: DataFrame) -> DataFrame:
    """One step: ``state`` holds nodes (``grp``, ``at``, ``digest``, ``path`` and more), ``asked`` children (``grp``, ``at`` and more)."""
    carried = [c for c in state.columns if c not in ("grp", "at", "digest", "path")]
    more = [c for c in asked.columns if c not in ("grp", "at")]
    opened = state.join(records, "digest").withColumnRenamed("at", "up").drop("digest")
    asked = asked.withColumn("up", F.shiftright("at", BITS)).withColumn("digit", F.col("at").bitwiseAND(FANOUT - 1).cast("int"))
    both = asked.join(opened, ["grp", "up"])
    step = F.array(_segment(F.col("children"), F.col("digit")))
    chosen = F.get("children", F.col("digit"))
    return both.select("grp", "at", chosen.alias("digest"), F.concat("path", step).alias("path"), *carried, *more)


def _passed(asked: DataFrame, levels: int) -> dict[int, DataFrame]:
    """The places (``grp``, ``at``) at heights 1 to ``levels`` - 1 that the way to ``asked`` (``grp``, ``at``, ``height``) passes, each once."""
    out, below = {}, asked
    for height in range(1, levels):
        above = below.filter(F.col("height") > height).select("grp", F.shiftright("at", BITS).alias("at"), "height")
        out[height] = below = saved(above.distinct())
    return out


def prove(own: Manifest, requests: DataFrame) -> DataFrame:
    """The requested leaves with their proofs: the columns of ``requests`` and ``digest``, ``path``, ``subroot``, ``root``.

    ``requests`` has ``grp``, ``rank`` and ``size`` of leaves, each once, and any columns beside; a
    place that the manifest does not have gives no row.  ``path`` lists, from the leaf up to the
    root, the joined digests ``left`` and ``right`` of the leaf or node within its run.
    """
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    here = [F.lit("").alias("grp"), F.lit(0).cast("long").alias("at")]
    state = own.root.select(*here, "digest", nothing.alias("path"), F.col("digest").alias("root"))
    # from the root to the subroots of the sources that are asked for
    sources = requests.select("grp").distinct().join(own.roots, "grp")
    tall = len(own.root_records)
    sources = saved(sources.select(F.lit("").alias("grp"), F.col("rank").alias("at"), F.lit(tall).alias("height"), F.col("grp").alias("source"), F.col("height").alias("own_height")))
    passed = _passed(sources, tall)
    for height in range(tall, 0, -1):
        asked = passed[height - 1].select("grp", "at") if height > 1 else sources.select("grp", "at")
        state = _down(state, own.root_records[height - 1], asked)
    named = sources.select("at", "source", F.col("own_height").alias("height"))
    subroots = state.drop("grp").join(named, "at").select(
        F.col("source").alias("grp"), F.lit(0).cast("long").alias("at"), "digest", "path", "root", F.col("digest").alias("subroot"), "height"
    )
    subroots = saved(subroots)
    # from the subroots to the leaves; a source joins in at the height of its own tree
    leaves = requests.withColumn("height", _height(F.col("size"))).withColumnRenamed("rank", "at")
    tall, state = len(own.records), None
    passed = _passed(leaves, tall)
    for height in range(tall, 0, -1):
        begun = subroots.filter(F.col("height") == height).drop("height")
        state = begun if state is None else state.unionByName(begun)
        asked = passed[height - 1].select("grp", "at") if height > 1 else leaves.filter("height > 0").drop("height")
        state = _down(state, own.records[height - 1], asked)
    alone = leaves.filter("height = 0").drop("height").join(subroots.drop("height", "at"), "grp")
    found = alone if state is None else state.unionByName(alone)
    found = found.filter("digest is not null").withColumn("path", F.reverse("path"))
    return found.withColumnRenamed("at", "rank")


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""
    return F.aggregate(path, digest, lambda own, x: F.sha2(F.concat(x["left"], own, x["right"]), 256))


def checked(documents: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    The manifest is built from the rows as they are; then every leaf is proved, with the digest of
    its tampered text where it was tampered with, and ``verified`` says whether the root came out.
    Nulls, empty texts and repeated rows or keys are leaves like others; no rows give no rows.
    """
    own = manifest(document_leaves(documents))
    found = prove(own, own.leaves.select("grp", "rank", "size", "doc_id", "claimed"))
    root = folded(F.coalesce("claimed", "digest"), F.col("path"))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(source_levels: int = 5, top_levels: int = 3) -> str:
    """DuckDB SQL of :func:`checked`, for sources of up to 16 ** ``source_levels`` rows."""
    upper = "".join(map(chr, range(65, 91)))
    value = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(value.format(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    parts = [f"""leaf AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {digest("text")} AS leaf, {digest(f"translate(text, '{upper}', '{upper.lower()}')")} AS low,
        xor({CRC32.format("coalesce(doc_id::VARCHAR, '-')")}, 4294967295::BIGINT) % 5 = 0 AND doc_id IS NOT NULL AS hit FROM documents)""",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leaf)",
        "s0 AS (SELECT grp, r AS pos, leaf AS digest FROM ranked)"]

    def tree(name: str, levels: int) -> None:
        run = "OVER (PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN {0})"
        for i in range(levels):
            parts.append(f"""{name}p{i} AS (SELECT grp, pos, digest, count(*) OVER (PARTITION BY grp) AS size,
                coalesce(string_agg(digest, '') {run.format("UNBOUNDED PRECEDING AND 1 PRECEDING")}, '') AS l,
                coalesce(string_agg(digest, '') {run.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")}, '') AS r FROM {name}{i})""")
            parts.append(f"""{name}{i + 1} AS (SELECT grp, pos // 16 AS pos, CASE WHEN max(size) = 1 THEN min(digest)
                ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}p{i} GROUP BY grp, pos // 16)""")

    tree("s", source_levels)
    parts.append(f"t0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, digest, grp AS source FROM s{source_levels})")
    tree("t", top_levels)
    steps = [(f"s{i}", f"s.grp = ranked.grp AND s.pos = ranked.r // {16**i}", f"sp{i}") for i in range(source_levels)]
    steps += [(f"t{i}", f"s.pos = t0.pos // {16**i}", f"tp{i}") for i in range(top_levels)]
    joins = "".join(f" JOIN {table} AS {name}_ ON {on.replace('s.', name + '_.')}" for name, on, table in steps)
    siblings = " || ".join(f"CASE WHEN {name}_.size > 1 THEN {name}_.l || {name}_.r ELSE '' END" for name, _, _ in steps)
    columns = ", ".join(f"{name}_.size AS {name}_size, {name}_.l AS {name}_l, {name}_.r AS {name}_r" for name, _, _ in steps)
    parts.append(f"""joined AS (SELECT doc_id, leaf, t0.digest AS subroot, t{top_levels}.digest AS root, sha256({siblings}) AS proof_sha256,
        CASE WHEN hit THEN low ELSE leaf END AS own, {columns}
        FROM ranked JOIN t0 ON t0.source = ranked.grp CROSS JOIN t{top_levels}{joins})""")
    last = "joined"
    for i, (name, _, _) in enumerate(steps):
        parts.append(f"f{i} AS (SELECT * REPLACE (CASE WHEN {name}_size > 1 THEN sha256({name}_l || own || {name}_r) ELSE own END AS own) FROM {last})")
        last = f"f{i}"
    parts_sql = ",\n".join(parts)
    return f"WITH {parts_sql}\nSELECT doc_id, leaf, subroot, root, proof_sha256, own AS folded_root, own = root AS verified FROM {last}"


#: DuckDB SQL of the registered query.
ORACLE = _oracle()
