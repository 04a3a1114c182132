"""Directories as a data source and by rounds, and exact decoding."""

import os
import random

import pytest
from pyspark.sql import functions as F

from debtscope import dims
from debtscope.sources import tree
from debtscope.sources.corpus import decode, scan_directory

NAMES = ["a.py", "_x/.hid.js", "p/__init__.py", "p/q/r/s/deep.py", "build/no.py", "p/node_modules/no.js", "p/q/r/.git/no", "p/q/build.py",
         "p/q/r/s/t/u.c", *[f"wide/d{i}/f{j}.py" for i in range(20) for j in range(3)]]


@pytest.fixture()
def root(tmp_path):
    for name in NAMES:
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    (tmp_path / "t" / "empty").mkdir()
    return tmp_path / "t"


def walk(root):
    out = []
    for folder, below, files in os.walk(root):
        below[:] = [d for d in below if d not in dims.IGNORED_DIRS]
        out += [os.path.relpath(os.path.join(folder, f), root) for f in files]
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 200])
def test_format_equals_a_plain_walk(spark, root, partitions):
    files = tree.register(spark).read.format("source_tree").option("partitions", partitions).load(str(root))
    rows = files.collect()
    assert sorted(r["path"] for r in rows) == walk(root) and {r["repo"] for r in rows} == {"t"} and {r["error"] for r in rows} == {None}
    assert all(bytes(r["content"]).decode() == r["path"] for r in rows)
    assert files.rdd.getNumPartitions() <= partitions


def test_what_cannot_be_read_is_reported(spark, root, tmp_path, monkeypatch):
    (root / "dangling.py").symlink_to(root / "gone.py")
    files = tree.register(spark).read.format("source_tree")
    rows = files.load(str(tmp_path / "none")).collect()
    assert [(r["path"], r["content"], r["error"]) for r in rows] == [("", None, "No such file or directory")]
    roots = spark.createDataFrame([("r", str(root)), ("g", str(tmp_path / "none"))], "repo string, root string")
    found = scan_directory(roots, str(tmp_path / "rounds")).collect()
    assert sorted(r["path"] for r in found if r["error"] is None) == walk(root)[0:] or "dangling.py" in walk(root)
    assert [(r["repo"], r["error"]) for r in found if r["error"]] == [("g", "No such file or directory")]


def test_rounds_deal_out_every_level(spark, root, tmp_path):
    roots = spark.createDataFrame([("r", str(root))], "repo string, root string")
    found = scan_directory(roots, str(tmp_path / "rounds")).collect()
    assert sorted(r["path"] for r in found) == walk(root)
    assert len(os.listdir(tmp_path / "rounds")) == 6  # the root and five levels below it


def test_tree_is_written_and_read_back(spark, tmp_path):
    rows = [("r", "a/b.py", "x"), ("r", "_c.js", "é\n"), ("s", "a/b.py", "")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    back = tree.register(spark).read.format("source_tree").load(tree.write(files, f"file://{tmp_path}/out"))
    assert sorted((r["path"], bytes(r["content"]).decode()) for r in back.collect()) == [("r/_c.js", "é\n"), ("r/a/b.py", "x"), ("s/a/b.py", "")]


def test_decoding_drops_malformed_bytes_only(spark):
    rng = random.Random(4)
    pieces = [b"\xef\xbf\xbd", b"\xef\xb7\x90", b"0", b"1", b"a", b"\xc3\xa9", b"\xf0\x9f\x99\x82", b"\xff", b"\xc3", b"\xe2\x82", b"\xf0\x9f", b"\x80",
              b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\xef", b"\xbf\xbd", b"\x00"]
    raw = [b"".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)] + [bytes(rng.randbytes(rng.randint(0, 9))) for _ in range(3000)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, content binary").select("i", decode(F.col("content")).alias("t"))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    assert {r["i"]: r["t"] for r in frame.collect()} == {i: x.decode("utf-8", "ignore") for i, x in enumerate(raw)}
