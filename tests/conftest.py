import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from debtscope.session import configure  # noqa: E402
from debtscope.sources.corpus import source_files  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sources(spark):
    """Build source files from ``{path: content}``; the path is the file key."""

    def build(contents: dict, repo: str = "r"):
        kind = "binary" if any(isinstance(c, bytes) for c in contents.values()) else "string"
        rows = [(path, repo, path, content) for path, content in contents.items()]
        return source_files(spark.createDataFrame(rows, f"file_id string, repo string, path string, content {kind}"))

    return build
