"""Matches, line numbers and smells against Python's own regular expressions."""

import random
import re

import pytest

from debtscope.functions import regex as R
from debtscope.operators.matches import match_rows
from debtscope.operators.smells import deep_line_rows, merged_ranges, smell_rows
from oracles.fixed import SMELL_PATTERNS
from pyspark.sql import functions as F

WORDS = [
    "def ", "async ", "f(", ")", "function ", "class ", "public ", "static ", "int ", "x", " ", "  ", "\n", "\n\n", "\t", "{", "}", '"',
    "'", "#", "//", "/*", "TODO", "fixme", "print (", "except", ":", "12", "345", "0x1F2E", "-", ".", "/usr/", "C:\\", "return", "import ",
    "é", "²", "\u3000", "\x1c", "const ", "= ", "=>", "fn ", "func ", "let ", "abcdefghij", "    ", "\u0301",
]
# The detectors in Python's dialect; texts for hard-coded paths are in the oracle comparison.
PYTHON = {key: re.compile(pattern) for key, pattern in SMELL_PATTERNS.items() if key not in ("long_param_list", "hardcoded_path")}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = {f"t{i}.md": "".join(rng.choices(WORDS, k=rng.randint(5, 90))) for i in range(300)}
    made["wrap.md"] = "#\nTODO\n# return\nx = 1\n"
    made["deep.md"] = "\n".join(["def g(a):"] + ["x"] + [" " * 20 + "y"] * 3 + ["z"] * 3 + [" " * 20 + "y"])
    made["dup.md"] = 'a = "0123456789" + "0123456789"\n' * 3
    return made


def line_of(text, at):
    return text.count("\n", 0, at) + 1


@pytest.mark.parametrize("key", PYTHON)
def test_match_rows(sources, texts, key):
    rows = match_rows(sources(texts), R.SMELL_PATTERNS[key]).collect()
    found = sorted((r["file_id"], r["pos"], r["line"], r["match"]) for r in rows)
    expected = sorted(
        (path, i, line_of(text, m.start()), m.group()) for path, text in texts.items() for i, m in enumerate(PYTHON[key].finditer(text))
    )
    assert expected and found == expected


def test_smell_counts_and_samples(sources, texts):
    rows = smell_rows(sources(texts)).collect()
    found = {(r["file_id"], r["key"]): (r["count"], r["lines"]) for r in rows if r["key"] in PYTHON}
    expected = {}
    for key, pattern in PYTHON.items():
        for path, text in texts.items():
            lines = [line_of(text, m.start()) for m in pattern.finditer(text)]
            if lines:
                expected[path, key] = (len(lines), lines[:5])
    assert found == expected


def test_deep_nesting_places(sources, texts):
    files = sources({"deep.md": texts["deep.md"]})
    row = smell_rows(files).filter("key = 'deep_nesting'").first()
    assert (row["count"], row["lines"], row["formatted"]) == (4, [3, 4, 5, 9], ["[g]L3-5,L9"])
    assert {r["func"] for r in deep_line_rows(files).collect()} == {"g"}


def test_same_function_names_merge_and_outside_comes_last(sources):
    deep = " " * 20 + "x"
    text = "\n".join([deep, "def b():", deep, "def a():", deep, "def b():", deep, deep])
    row = smell_rows(sources({"m.md": text})).filter("key = 'deep_nesting'").first()
    assert row["formatted"] == ["[b]L3,L7-8", "[a]L5", "[global]L1"]


def test_long_function_uses_advisor_lines(sources):
    text = "def f():\n" + "    x\n" * 50
    row = smell_rows(sources({"f.md": text})).filter("key = 'long_function'").first()
    assert (row["count"], row["lines"], row["details"][0].asDict()) == (1, [1], {"name": "f", "length": 51})


def test_merged_ranges(spark):
    made = spark.createDataFrame([([49, 50, 51, 55],), ([3],), ([1, 3, 5],)], "n array<int>")
    assert [r[0] for r in made.select(merged_ranges(F.col("n"))).collect()] == [["L49-51", "L55"], ["L3"], ["L1", "L3", "L5"]]
