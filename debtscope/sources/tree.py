"""A directory tree as a data source: ``spark.read.format("source_tree").load(root)``.

Planning only looks at directories.  It expands them level by level until there are enough to
deal out; a directory that it has expanded is listed again by the task that reads its files, the
others are walked by their tasks, so no file name passes the driver.  A task reads one file at a
time.  For trees with a few directories that hold nearly everything see
``sources.corpus.scan_directory``, which deals out every level.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from debtscope.sources.corpus import entries

#: Directories dealt out for each partition, and partitions, unless the options ``partitions`` says otherwise.
SHARE, PARTITIONS = 4, 64


@dataclass
class Folders(InputPartition):
    """Directories of a partition, and whether to walk on below each."""

    folders: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    def __init__(self, root: str, repo: str, partitions: int):
        self.root, self.repo, self.number = root, repo, partitions

    def partitions(self) -> list[InputPartition]:
        """Expand directories until there are :data:`SHARE` for each partition, and deal them out in turn."""
        waiting, expanded = deque([""]), []
        while waiting and len(waiting) + len(expanded) < SHARE * self.number:
            folder = waiting.popleft()
            waiting += entries(self.root, folder)[0]
            expanded.append((folder, False))
        dealt = expanded + [(folder, True) for folder in waiting]
        return [Folders(dealt[i :: self.number]) for i in range(min(self.number, len(dealt)))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for start, deep in partition.folders:
            waiting = [start]
            while waiting:
                folder = waiting.pop()
                folders, files, error = entries(self.root, folder)
                if error:
                    yield self.repo, folder, None, error
                for path in files:
                    try:
                        with open(os.path.join(self.root, path), "rb") as handle:
                            yield self.repo, path, handle.read(), None
                    except OSError as failure:
                        yield self.repo, path, None, failure.strerror or str(failure)
                waiting += folders if deep else []


class SourceTree(DataSource):
    """Rows ``repo, path, content, error``: a row per file, and one per file or directory that cannot be read, with the reason.

    Options: ``repo`` (the root's base name), ``partitions``.  Ignored directories are not entered
    and links to directories not followed.  The root must be a mount that the driver and every
    executor see.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "repo string, path string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        root = self.options["path"]
        name = self.options.get("repo") or os.path.basename(os.path.normpath(root))
        return TreeReader(root, name, int(self.options.get("partitions", PARTITIONS)))


def write(files: DataFrame, root: str) -> str:
    """Write every file of ``repo, path, content`` below ``root``/``repo`` on the executors, which all see ``root``; the local path of the root."""
    root = root.removeprefix("file://")

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                path = os.path.join(root, row.repo, row.path)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                # a task that is run again replaces the file as a whole
                with open(f"{path}.{os.getpid()}", "wb") as handle:
                    handle.write(row.content.encode() if isinstance(row.content, str) else row.content)
                os.replace(handle.name, path)
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("repo", "path", "content").mapInPandas(written, "n long").agg(F.sum("n")).collect()
    os.makedirs(root, exist_ok=True)
    return root


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session."""
    spark.dataSource.register(SourceTree)
    return spark
