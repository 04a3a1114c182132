"""Function patterns in linear time: the same matches as Python's, whatever is opened and never closed."""

import random
import re
import time

import pytest

from debtscope.functions import openings as O
from debtscope.operators.hotspots import function_rows
from oracles.fixed import FUNCTION_PATTERNS
from pyspark.sql import functions as F

EXTENSION = {"Python": "py", "JavaScript": "js", "TypeScript": "ts", "Java": "java", "C": "c", "C++": "cpp", "C#": "cs", "PHP": "php", "Go": "go"}
PIECES = [
    "(", ")", "(", ")", "{", "}", "\n", " ", "  ", "\t", "foo", "a", "int ", "*", "<", ">", "<T>", "=", ":", ": x", "::", "=>", ",",
    "function ", "const ", "let x", "async ", "public ", "static ", "\npublic int ", "func ", "func (", "def ", "\ndef f", "throws E, F ",
    "override ", "const {", ") {", "\n{", ") => ", "foo(", "\nint foo(", "bar (a", "﷒", "﷓", "﷔", "﷕", "﷖", "﷘", "﷐",
]


@pytest.fixture()
def always(monkeypatch):
    """Prepare every text, however short."""
    monkeypatch.setattr(O, "_OPENINGS", "")


@pytest.mark.parametrize("extractor", EXTENSION)
def test_same_matches_as_python(sources, always, extractor):
    rng = random.Random(extractor)
    texts = {f"t{i}.{EXTENSION[extractor]}": "".join(rng.choices(PIECES, k=rng.randint(3, 60))) for i in range(700)}
    rows = function_rows(sources(texts), keep_all=True).collect()
    found = sorted((r["file_id"], r["name"], r["line"]) for r in rows)
    pattern = re.compile(FUNCTION_PATTERNS[extractor][0])
    expected = sorted(
        (path, next(g for g in m.groups() if g), text.count("\n", 0, m.start()) + 1) for path, text in texts.items() for m in pattern.finditer(text)
    )
    assert expected and found == expected


def test_texts_come_back_as_they_were(spark, always):
    text = "int a\nfoo(b, <c> : (d\nx <e) = (f)\n{ func (g"
    rows = spark.createDataFrame([(text,)], "text string")
    for extractor in [*EXTENSION, "Rust"]:
        assert rows.select(O.restored(O.prepared(F.col("text"), extractor))).first()[0] == text


OPEN = {
    "words.c": "alpha beta gamma delta epsilon\n",
    "heads.c": "alpha beta (x\n",
    "stars.c": "alpha\n*beta *gamma(x) ;\n",
    "call.cpp": "foo(a, b\n",
    "scope.cpp": "a:b::",
    "def.py": "def f(\n",
    "arrow.js": "const f = (a, b\n",
    "typed.ts": "const x: foo bar\n",
    "method.ts": "foo(a, b\n",
    "method.java": "\n\npublic int foo(a, b",
    "generic.java": "\n\nList<int foo",
    "generic.cs": "\n\nList<int foo",
    "method.cs": "\n\npublic int foo(a, b",
    "function.php": "function f($a,\n",
    "receiver.go": "func (r *T\n",
    "function.go": "func f(a\n",
}


@pytest.mark.parametrize("closing", ["", ")", ") ; ("])
def test_a_megabyte_of_openings_takes_seconds(sources, closing):
    """Nothing closes, one closing stands at the end, or one that no definition goes on from."""
    texts = {name: piece * (1_000_000 // len(piece)) + closing for name, piece in OPEN.items()}
    start = time.perf_counter()
    function_rows(sources(texts), keep_all=True).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - start < 60


def test_time_grows_with_the_text(sources):
    def seconds(size: int) -> float:
        texts = {name: piece * (size // len(piece)) for name, piece in OPEN.items()}
        start = time.perf_counter()
        function_rows(sources(texts), keep_all=True).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(50_000)
    assert seconds(600_000) < 4 * max(seconds(300_000), 1.0)
