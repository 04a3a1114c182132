"""Files cut into segments: the same counts as whole, whatever the cuts."""

import random

import pytest
from pyspark.sql import functions as F

from debtscope.operators import segments as G
from debtscope.operators.profile import file_metrics
from debtscope.sources.corpus import read_segments, source_files

PIECES = {
    "py": ['"""', "'''", "# c", "x", "", "  ", "}"],
    "js": ["/*", "*/", "// c", "x", "", "/*/", "}"],
    "lua": ["--[[", "]]", "-- c", "x", ""],
    "ps1": ["<#", "#>", "# c", "x", ""],
    "html": ["<!--", "-->", "/*", "*/", "// c", "<script>", "</script>", "<script src=a>", "x", "", "}"],
}
COLUMNS = ["file_id", "total", "code", "comments", "boilerplate", "logic_lines"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = {}
    for ext, pieces in PIECES.items():
        for i in range(60):
            lines = [" ".join(rng.choices(pieces, k=rng.choice([1, 1, 2]))) for _ in range(rng.randint(0, 40))]
            made[f"f{i}.{ext}"] = "\n".join(lines) + rng.choice(["", "\n", "\n\n"])
    return {**made, "empty.js": "", "blank.py": "\n", "long.js": "/* " + "y" * 500 + "\n*/ x\n" + "z" * 300}


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_segments_count_like_the_whole(sources, texts, tmp_path, size):
    whole = file_metrics(sources(texts)).select(COLUMNS).collect()
    cut = G.cut(sources(texts), size)
    assert size > 1000 or cut.count() > 3 * len(texts) / 2
    assert sorted(map(tuple, G.line_counts(cut, str(tmp_path / "f")).select(COLUMNS).collect())) == sorted(map(tuple, whole))


def test_segments_of_an_order_are_composed(spark):
    steps = spark.createDataFrame(
        [("a", 0, [1, 1, 3, 3]), ("a", 1, [0, 1, 2, 3]), ("a", 2, [2, 0, 2, 0]), ("b", 0, [3, 3, 3, 3]), ("a", 3, [0, 1, 2, 3])],
        "file_id string, part int, leaves array<int>",
    )
    got = sorted(map(tuple, G.entered(steps).collect()))
    assert got == [("a", 0, 0), ("a", 1, 1), ("a", 2, 1), ("a", 3, 0), ("b", 0, 0)]


@pytest.mark.parametrize("size", [1, 9, 64, 1 << 20])
def test_ranges_of_files_give_the_same_lines(spark, texts, tmp_path, size):
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    paths = spark.createDataFrame([("r", str(tmp_path), name) for name in [*texts, "gone.py"]], "repo string, root string, path string")
    rows = read_segments(paths, size).collect()
    found = {}
    for row in sorted(rows, key=lambda r: (r["path"], r["part"])):
        found.setdefault(row["path"], []).append(row["content"])
    assert found.pop("gone.py") == [None]
    assert {name: b"".join(parts).decode() for name, parts in found.items()} == texts
    assert all(part.endswith(b"\n") for parts in found.values() for part in parts[:-1])
    # a task holds a range and the rest of its last line
    assert all(part.count(b"\n") <= size for parts in found.values() for part in parts)


def test_large_file_without_whole_text(spark, tmp_path):
    lines = ["/* open", "still", "*/ x", "if (a) { b(); }", ""] * 40_000
    (tmp_path / "big.js").write_text("\n".join(lines))
    paths = spark.createDataFrame([("r", str(tmp_path), "big.js")], "repo string, root string, path string")
    segments = source_files(read_segments(paths, 50_000))
    assert segments.select(F.max(F.length("text"))).first()[0] < 60_000
    row = G.line_counts(segments, str(tmp_path / "facts")).first()
    assert (row["total"], row["comments"], row["code"], row["boilerplate"]) == (199_999, 120_000, 40_000, 39_999)


def test_only_letters_are_shuffled(sources, texts, tmp_path):
    G.line_counts(G.cut(sources(texts), 40), str(tmp_path / "f")).collect()
    reduced = sources(texts).sparkSession.read.parquet(str(tmp_path / "f"))
    assert reduced.columns == ["file_id", "part", "is_logic", "html", "classes", "marks"]
    assert G.facts(G.cut(sources(texts), 40))._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
