"""The ``files`` relation: ``file_id, repo, path, content`` and the language columns.

Everything here is row-local.  The path is tested before the content is touched, so the
text column is decoded only for files that stay.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from debtscope import dims
from debtscope.functions import text as X


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a table with ``repo, path, content``; ``content`` may be string or binary."""
    return with_file_id(spark.read.format(fmt).load(path))


def with_file_id(files: DataFrame) -> DataFrame:
    """Key a corpus by a digest of repository and path unless it brings its own key."""
    if "file_id" in files.columns:
        return files
    return files.withColumn("file_id", F.md5(F.concat_ws("\x1f", "repo", "path")))


def entries(root: str, below: str) -> tuple[list[str], list[str], str | None]:
    """Directories to enter and files of one directory, and why it cannot be read; ignored directories and links to directories are skipped."""
    folders, files = [], []
    try:
        with os.scandir(os.path.join(root, below)) as found:
            for entry in found:
                path = f"{below}/{entry.name}" if below else entry.name
                if entry.is_dir():
                    if entry.name not in dims.IGNORED_DIRS and not entry.is_symlink():
                        folders.append(path)
                elif entry.is_file():
                    files.append(path)
    except OSError as error:
        return folders, files, error.strerror or str(error)
    return folders, files, None


def scan_directory(roots: DataFrame, folder: str) -> DataFrame:
    """``repo, root, path, error`` of every file below the roots (``repo, root``) and of every directory that cannot be read.

    A round lists the directories of one level and deals those they hold out anew, until none is
    left, so neither a deep nor a wide root is walked by one task.  Ignored directories are never
    entered.  ``root`` must be a mount that every executor sees; each round is written below
    ``folder``, which all executors share.
    """
    schema = "repo string, root string, path string, kind string, error string"

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                folders, files, error = entries(row.root, row.path)
                found = [(path, "file", None) for path in files] + [(path, "folder", None) for path in folders]
                found += [(row.path, "error", error)] if error else []
                out = pd.DataFrame(found, columns=["path", "kind", "error"])
                yield out.assign(repo=row.repo, root=row.root)[["repo", "root", "path", "kind", "error"]]

    spark = roots.sparkSession
    waiting, rounds = roots.select("repo", "root", F.lit("").alias("path")), []
    while True:
        rounds.append(f"{folder}/round-{len(rounds):04d}")
        waiting.repartition("root", "path").mapInPandas(listed, schema).write.parquet(rounds[-1])
        waiting = spark.read.schema(schema).parquet(rounds[-1]).filter("kind = 'folder'").select("repo", "root", "path")
        if waiting.isEmpty():
            break
    return spark.read.schema(schema).parquet(*rounds).filter("kind <> 'folder'").select("repo", "root", "path", "error")


def list_directory(roots: DataFrame, levels: int = 2) -> DataFrame:
    """``repo, root, path`` of every file below the roots (``repo, root``), without the ignored directories.

    The first levels are listed one by one, each level's directories dealt out anew, so that one
    large root is walked by many tasks; below them a task walks on by itself.  :func:`scan_directory`
    deals every level and reports what it cannot read; this needs no folder to write to.
    """

    def step(walk: bool):
        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    waiting = [row.path]
                    while waiting:
                        folders, files, _ = entries(row.root, waiting.pop())
                        found = [(path, False) for path in files] + ([] if walk else [(path, True) for path in folders])
                        waiting += folders if walk else []
                        out = pd.DataFrame(found, columns=["path", "folder"])
                        yield out.assign(repo=row.repo, root=row.root)[["repo", "root", "path", "folder"]]

        return listed

    schema = "repo string, root string, path string, folder boolean"
    waiting, files = roots.select("repo", "root", F.lit("").alias("path")), None
    for level in range(levels + 1):
        found = waiting.repartition("root", "path").mapInPandas(step(level == levels), schema)
        own = found.filter(~F.col("folder")).drop("folder")
        files = own if files is None else files.unionByName(own)
        waiting = found.filter("folder").drop("folder")
    return files


def read_directory(paths: DataFrame) -> DataFrame:
    """Open every file of a table ``repo, root, path`` (see :func:`list_directory`) on the executors.

    Spark's own file sources skip names that start with ``_`` or ``.`` and so lose
    ``__init__.py``; a table of paths with a small reader per batch does not.  ``root`` must be
    a mount that every executor sees.  A file that cannot be read gets null content.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    with open(os.path.join(row.root, row.path), "rb") as handle:
                        content = handle.read()
                except OSError:
                    content = None
                yield pd.DataFrame({"repo": [row.repo], "path": [row.path], "content": [content]})

    opened = paths.select("repo", "root", "path").mapInPandas(read, "repo string, path string, content binary")
    return with_file_id(opened)


def read_segments(paths: DataFrame, size: int = 64 << 20) -> DataFrame:
    """``repo, path, part, content`` of the files in ``repo, root, path``: stretches of about ``size`` bytes, each ending at a line end.

    A stretch starts at the first line that begins in its range of bytes and ends with the last
    one that does, so a task holds one stretch, however large the file.  Ranges in which no line
    begins give no row, unless the file is empty; a file that cannot be read gets null content.
    """

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for row in batch.itertuples(index=False):
                try:
                    sizes.append(os.path.getsize(os.path.join(row.root, row.path)))
                except OSError:
                    sizes.append(-1)
            yield batch.assign(bytes=sizes)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                content, begins = None, True
                try:
                    with open(os.path.join(row.root, row.path), "rb") as handle:
                        if row.start:
                            handle.seek(row.start - 1)
                            handle.readline()
                        here = handle.tell()
                        begins = here < min(row.start + size, row.bytes) or row.bytes <= 0
                        content = handle.read(max(0, row.start + size - here))
                        if content and not content.endswith(b"\n"):
                            content += handle.readline()
                except OSError:
                    pass
                if begins:
                    yield pd.DataFrame({"repo": [row.repo], "path": [row.path], "part": [row.part], "content": [content]})

    schema = "repo string, root string, path string"
    sized = paths.select("repo", "root", "path").mapInPandas(measured, schema + ", bytes long")
    starts = F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size))
    ranges = sized.select("repo", "root", "path", "bytes", F.posexplode(starts).alias("part", "start"))
    dealt = ranges.repartition("repo", "path", "part")
    return with_file_id(dealt.mapInPandas(read, "repo string, path string, part int, content binary"))


def decode(content: Column) -> Column:
    """UTF-8 text of a binary column with malformed bytes dropped.

    The repair puts U+FFFD for malformed bytes, so one that the text has itself is escaped
    meanwhile; its three bytes can belong to no other character, whatever stands around them.
    """
    raw = content.cast("string")
    bad, escape = F.lit("\ufffd"), F.lit("\ufdd0")
    escaped = F.replace(F.replace(raw, escape, F.lit("\ufdd00")), bad, F.lit("\ufdd01"))
    repaired = F.replace(F.make_valid_utf8(escaped), bad, F.lit(""))
    restored = F.replace(F.replace(repaired, F.lit("\ufdd01"), bad), F.lit("\ufdd00"), escape)
    return F.when(F.is_valid_utf8(raw), raw).otherwise(restored)


def prune_directories(files: DataFrame) -> DataFrame:
    """Drop files below an ignored directory name (exact, case-sensitive; not the file name)."""
    parts = F.split("path", "/", -1)
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ignored = F.array(*[F.lit(name) for name in dims.IGNORED_DIRS])
    return files.filter(~F.arrays_overlap(parents, ignored))


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the base name, empty without a dot."""
    base = X.base_name(path)
    return F.when(F.contains(base, F.lit(".")), F.lower(F.substring_index(base, ".", -1))).otherwise("")


def with_language(files: DataFrame) -> DataFrame:
    """Inner join on the language table; files of unknown extension drop out."""
    keyed = files.withColumn("ext", extension(F.col("path")))
    return keyed.join(F.broadcast(dims.languages(files.sparkSession)), "ext")


def exempt(path: Column) -> Column:
    """Whether the base name is one of those that may be complex."""
    return X.base_name(path).isin(dims.EXEMPT_FILES)


def source_files(files: DataFrame) -> DataFrame:
    """Pruned files with language columns and ``text`` (decoded, LF newlines; null = unreadable).

    ``strict_text`` is the text for the syntax parser, which accepts no malformed bytes.
    """
    binary = dict(files.dtypes)["content"] == "binary"
    kept = with_language(prune_directories(with_file_id(files)))
    text = X.unix_newlines(decode(F.col("content")) if binary else F.col("content"))
    if binary:
        raw = F.col("content").cast("string")
        strict = F.when(F.is_valid_utf8(raw), X.unix_newlines(raw))
    else:
        strict = text
    wants_syntax = F.col("lang") == "Python"
    return kept.withColumns(
        {
            "is_exempt": exempt(F.col("path")),
            "text": text,
            "strict_text": F.when(wants_syntax, strict),
        }
    ).drop("content")
