"""Corpora derived from the given tables.

``lineitem`` rows become lines of code, ``documents``, ``pages`` and ``conversations`` become
text and HTML files.  A code file collects the rows that share a slot; the slot mixes all four
key columns, so no single part, supplier or order can fill a file however many rows it has.  The
number of slots follows the number of rows, so one more row deals the rows to other files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from debtscope.functions.stage import staged
from debtscope.sources import templates as T

KEYS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
ROWS_PER_SLOT = 24
BIG_FILE_BASE = 1_000_000_000_000
DOCUMENT_BASE = 2_000_000_000_000
PAGE_BASE = 3_000_000_000_000
TURN_BASE = 4_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(values: dict, key: str) -> Column:
    entries = ", ".join(f"{part!r}" for pair in values.items() for part in pair)
    return F.expr(f"map({entries})[{key}]")


def _choose(values: list[str], index: str) -> Column:
    return F.expr(f"element_at(array({', '.join(map(repr, values))}), cast({index} as int) + 1)")


def _row_key(orderkey: Column, linenumber: Column, suppkey: Column, partkey: Column) -> Column:
    """Picks the template of a row within its family."""
    return orderkey * 7 + suppkey * 3 + linenumber + partkey


def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: ``file_id, ext, family, k`` and the key columns."""
    items = table(spark, sf_dir, "lineitem").select(*KEYS)
    slots = F.greatest(F.lit(1), F.floor(items.agg(F.count("*")).scalar() / ROWS_PER_SLOT)).cast("long")
    mixed = F.expr("l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709 + l_linenumber * 15485863")
    keyed = staged(items, KEYS, slot=mixed % slots)
    file_id = F.when(F.col("slot") % 4 == 0, F.lit(BIG_FILE_BASE) + F.floor(F.col("slot") / 40)).otherwise(F.col("slot"))
    typed = keyed.withColumn("file_id", file_id)
    typed = typed.withColumn("ext", _choose(T.EXTENSIONS, f"file_id % {len(T.EXTENSIONS)}"))
    familied = typed.withColumn("family", _lookup(T.FAMILY_OF_EXTENSION, "ext"))
    size = _lookup(T.FAMILY_SIZES, "family")
    row_key = _row_key(*map(F.col, KEYS))
    columns = {name: F.col(name) for name in ("file_id", "ext", "family")}
    return staged(familied, KEYS, **columns, k=(row_key % size).cast("int"))


def _code_path(file_id: Column, ext: Column) -> Column:
    def every(n: int) -> Column:
        return file_id % n == 0

    number = file_id.cast("string")
    folder = F.concat(
        F.when(every(22), "build/").when(every(11), "web/node_modules/").otherwise(""),
        F.lit("src/m"),
        (file_id % 10).cast("string"),
        F.lit("/"),
    )
    shown = F.when(every(19), F.lit("txt")).when(every(17), F.upper(ext)).otherwise(ext)
    plain = F.concat(F.lit("f"), number, F.lit("."), shown)
    exempt = F.concat(F.lit("d"), number, F.lit("/"), _lookup(T.EXEMPT_NAME_OF_EXTENSION, "ext"))
    name = F.when(every(23), F.concat(F.lit("Makefile"), number))
    name = name.when(every(13) & ext.isin(*T.EXEMPT_NAME_OF_EXTENSION), exempt)
    return F.concat(folder, name.otherwise(plain))


def _code_lines() -> Column:
    """The lines of a code file, from its rows in order of their keys; a row comes out as often as the table has it."""
    size = F.size("bodies")

    def lines(row: Column) -> Column:
        token = F.concat(F.lit("r"), F.concat_ws("_", *[row[key] for key in KEYS]))
        body = F.element_at("bodies", (_row_key(*[row[key] for key in KEYS]) % size).cast("int") + 1)
        body = F.when(F.contains(body, F.lit("@")), F.replace(body, F.lit("@"), token)).otherwise(body)
        return F.when(row["count"] == 1, body).otherwise(F.array_join(F.array_repeat(body, row["count"].cast("int")), "\n"))

    return F.transform("rows", lines)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` relation of generated code; only keys are shuffled, the bodies join them in the file."""
    rows = code_rows(spark, sf_dir).filter((F.col("k") >= 0) & F.col("family").isNotNull())
    # repeated rows are counted first, so they meet in the map tasks and come out as often as they went in
    rows = rows.groupBy("file_id", "ext", *KEYS).count()
    grouped = rows.groupBy("file_id", "ext").agg(F.sort_array(F.collect_list(F.struct(*KEYS, "count"))).alias("rows"))
    by_family = {name: [t.body for t in T.TEMPLATES if t.family == name] for name in T.FAMILY_SIZES}
    bodies = F.create_map(*[part for name, texts in by_family.items() for part in (F.lit(name), F.array(*map(F.lit, texts)))])
    furnished = staged(grouped, ["file_id", "ext", "rows"], bodies=F.element_at(bodies, _lookup(T.FAMILY_OF_EXTENSION, "ext")))
    return staged(
        furnished,
        ["file_id"],
        repo=F.concat(F.lit("repo"), (F.col("file_id") % 5).cast("string")),
        path=_code_path(F.col("file_id"), F.col("ext")),
        content=F.array_join(_code_lines(), "\n"),
    )


def _text_files(rows: DataFrame, file_id: Column, repo: str, path: Column, content: Column) -> DataFrame:
    return staged(rows, [], file_id=file_id.cast("long"), repo=F.lit(repo), path=path, content=content)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file; the extensions take turns so that prose meets every language."""
    key = F.col("doc_id")
    path = F.concat(F.lit("docs/d"), key.cast("string"), F.lit("."), _choose(T.EXTENSIONS, f"doc_id % {len(T.EXTENSIONS)}"))
    return _text_files(table(spark, sf_dir, "documents"), key + DOCUMENT_BASE, "documents", path, F.col("text"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an HTML file with a line break after each tag."""
    key = F.col("page_id")
    path = F.concat(F.lit("pages/p"), key.cast("string"), F.lit(".html"))
    content = F.replace("html", F.lit(">"), F.lit(">\n"))
    return _text_files(table(spark, sf_dir, "pages"), key + PAGE_BASE, "pages", path, content)


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a Markdown file; turns are never gathered per conversation."""
    conv, turn = F.col("conv_id"), F.col("turn")
    path = F.concat(F.lit("talk/c"), conv.cast("string"), F.lit("/t"), turn.cast("string"), F.lit(".md"))
    key = conv * 1_000_000 + turn + TURN_BASE
    return _text_files(table(spark, sf_dir, "conversations"), key, "conversations", path, F.col("text"))


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the four corpora."""
    code = code_files(spark, sf_dir)
    for part in (document_files, page_files, turn_files):
        code = code.unionByName(part(spark, sf_dir))
    return code
