"""Functions and classes against Python's regular expressions and plain scans."""

import random
import re
import time

import pytest

from debtscope.operators.hotspots import class_rows, function_rows, with_functions
from oracles.fixed import CLASS_PATTERNS, FUNCTION_PATTERNS, KEYWORDS

EXTENSION = {"Python": "py", "JavaScript": "js", "TypeScript": "ts", "Java": "java", "C": "c", "C++": "cpp", "C#": "cs", "PHP": "php",
             "Go": "go", "Rust": "rs", "Kotlin": "kt", "Lua": "lua"}
FUNCTIONS = {key: pattern for key, (pattern, _) in FUNCTION_PATTERNS.items()}
CLASSES = [key for key in CLASS_PATTERNS if key in ("Java", "C#", "Python", "Rust", "Kotlin")]
WORDS = [
    "public ", "static ", "private", "async ", "int ", "void ", "foo", "(", "(a)", ")", " {", "{", "}", "\n", "\n\n", "    ", "  ", "\t",
    "function ", "const ", "let ", "x", " = ", "=>", "fn ", "pub ", "func ", "fun ", "suspend ", "def ", "class ", "abstract ", "struct ",
    "object ", "local ", '"', "'", "\\", "if ", "&&", "a&&b", "else", "#", "://", "a::b ", "throws E ", "const", "override", "List<T> ", "(r *T) ",
    "foo(a) {", "x(b) {\n", "int bar(c) {\n", "\ndef f(a):\n", "\n    async def g(\nb):\n", "\n        if x:\n", "\n# c\n", "\nclass K:\n",
    "public static ", "static static public foo() {", "static  ", "staticpublic ", "public static static(a) {",
]
DECISIONS = re.compile(KEYWORDS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return {
        f"{name}{i}.{ext}": "".join(rng.choices(WORDS, k=rng.randint(10, 80)))
        for name, ext in EXTENSION.items()
        for i in range(80)
    }


def brace_end(text, start, limit):
    depth, quote, i = 0, None, start
    while i < limit:
        ch = text[i]
        if ch == "\\":
            i += 2
            continue
        if quote:
            quote = None if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if ch == "}" and depth == 0:
                return i
        i += 1
    return limit


def indent_end(lines, first):
    own = len(lines[first - 1]) - len(lines[first - 1].lstrip(" "))
    for number in range(first + 2, min(first + 200, len(lines)) + 1):
        line = lines[number - 1]
        if line.strip() and not line.strip().startswith("#") and len(line) - len(line.lstrip(" ")) <= own:
            return number - 1
    return min(first + 100, len(lines))


def expected_functions(extractor, text):
    lines, found = text.split("\n"), list(re.finditer(FUNCTIONS[extractor], text))
    for i, match in enumerate(found):
        first = text.count("\n", 0, match.start()) + 1
        if extractor == "Python":
            last = indent_end(lines, first)
        else:
            limit = found[i + 1].start() if i + 1 < len(found) else len(text)
            last = text.count("\n", 0, brace_end(text, match.start(), limit)) + 1
        body = lines[first - 1 : last]
        depth = max([(len(x) - len(x.lstrip())) // 4 for x in body if x.strip()], default=0)
        yield next(g for g in match.groups() if g), first, last - first, len(DECISIONS.findall("\n".join(body))) + 1, depth


@pytest.mark.parametrize("extractor", EXTENSION)
def test_functions(sources, texts, extractor):
    mine = {p: t for p, t in texts.items() if p.endswith("." + EXTENSION[extractor])}
    rows = function_rows(sources(mine), keep_all=True).collect()
    found = sorted((r["file_id"], r["name"], r["line"], r["length"], r["complexity"], r["nesting"]) for r in rows)
    expected = sorted((p, *f) for p, t in mine.items() for f in expected_functions(extractor, t))
    assert expected and found == expected


@pytest.mark.parametrize("extractor", CLASSES)
def test_classes(sources, texts, extractor):
    mine = {p: t for p, t in texts.items() if p.endswith("." + EXTENSION[extractor])}
    found = sorted((r["file_id"], r["name"], r["line"]) for r in class_rows(sources(mine)).collect())
    pattern, group = CLASS_PATTERNS[extractor]
    expected = sorted((p, m.group(group), t.count("\n", 0, m.start()) + 1) for p, t in mine.items() for m in re.finditer(pattern, t))
    assert expected and found == expected


GOLDEN = {
    "brace.js": ('function f() { s = "}"; \n}\n', [("f", 1, 1, 1, 0)]),
    "ctor.java": ("class A {\n    public Foo(int a) {\n    }\n}", [("Foo", 1, 2, 1, 1)]),
    "comment.py": ("def f():\n    a\n    b\n# note\n    c\nd\n", [("f", 1, 4, 1, 1)]),
    "second_line.py": ("def f():\nx\n    y\nz\n", [("f", 1, 2, 1, 1)]),
    "no_end.py": ("def f():\n" + "    x\n" * 150, [("f", 1, 100, 1, 1)]),
    "glued.go": ("func f() {\n a && b\n a&&b\n}", [("f", 1, 3, 2, 0)]),
    "tabs.go": ("func f() {\n\t\t\t\ta\n}", [("f", 1, 2, 1, 1)]),
    "lua.lua": ("local function f(a)\nend\ng = function()\nend\n", [("f", 1, 2, 1, 0), ("g", 3, 2, 1, 0)]),
    "none.rb": ("def f\nend", []),
}


def test_golden_functions(sources):
    rows = function_rows(sources({p: t for p, (t, _) in GOLDEN.items()}), keep_all=True).collect()
    for path, (_, expected) in GOLDEN.items():
        mine = [(r["name"], r["line"], r["length"], r["complexity"], r["nesting"]) for r in rows if r["file_id"] == path]
        assert sorted(mine) == sorted(expected), path


def test_only_hotspots_are_kept_most_complex_first(sources):
    text = "def a():\n    x\ndef b():\n" + "    if x: y\n" * 12 + "def c():\n" + "    z\n" * 40 + "end\n"
    row = with_functions(sources({"h.py": text})).first()
    assert [(f["name"], f["complexity"], f["length"]) for f in row["functions"]] == [("b", 13, 12), ("c", 1, 40)]


def test_white_space_and_word_runs_stay_fast(sources):
    texts = {"a.java": " " * 50_000, "b.php": " " * 50_000, "c.cs": "\n" * 50_000, "d.ts": "x" * 50_000, "e.cpp": "x" * 50_000}
    assert function_rows(sources(texts), keep_all=True).count() == 0


def test_long_runs_cost_neither_stack_nor_time(sources):
    texts = {
        "a.php": "static " * 150_000, "b.java": "public " * 150_000, "c.cs": "async " * 170_000, "d.java": "publicstatic" * 80_000,
        "e.c": "alpha beta gamma delta epsilon\n" * 1_500, "f.ts": "const x: foo bar\n" * 3_000, "g.cpp": "foo(a, b\n" * 3_000,
        "h.py": "def f(\n" * 3_000,
    }
    start = time.perf_counter()
    assert function_rows(sources(texts), keep_all=True).count() == 0
    assert time.perf_counter() - start < 120


def test_last_modifiers_may_be_type_and_name(sources):
    texts = {"a.java": "public " * 5_000 + "foo() {\n}", "b.cs": "static " * 5_000 + "(a)", "c.php": "public " * 5_000 + "function f()"}
    found = {r["file_id"]: r["name"] for r in function_rows(sources(texts), keep_all=True).collect()}
    assert found == {"a.java": "foo", "b.cs": "static", "c.php": "f"}
