"""Hand-reasoned expectations for single files."""

import pytest

from debtscope.operators.profile import file_metrics

NESTED = "".join("    " * i + "if a:\n" for i in range(8)) + "    " * 8 + "pass\n"
JS_LINES = "<script>\n" + "let a = 1;\n" * 5 + "</script>\n"

# path: (content, {metric: expected})
GOLDEN = {
    "empty.py": ("", dict(total=0, complexity=1, debt_score=0, quality_score=100, ast_ok=True)),
    "inline_block.js": ("x = 1 /* y */", dict(comments=1, code=0)),
    "docstring_swap.py": ('"""\na\n"""\nx = 1', dict(comments=3, code=1)),
    "mixed_triple.py": ('"""\na\n\'\'\'\nx = 1', dict(comments=3, code=1, ast_ok=False)),
    "blank_in_comment.js": ("/*\na\n\nb\n*/\nx", dict(comments=4, boilerplate=1, code=1)),
    "token_overlap.js": ("/*/\nx\n*/\ny", dict(comments=3, code=1)),
    "second_start_first.py": ("a = '''x''' + \"\"\"y\nz\n", dict(comments=2, code=0)),
    "lone.java": ("}", dict(boilerplate=1, code=0, logic_lines=1)),
    "bad.py": ("def (:\n        import os\n", dict(ast_ok=False, complexity=1, imports=0, max_nesting=2)),
    "nested.py": (NESTED, dict(ast_ok=True, max_nesting=0, complexity=9)),
    "switch.go": ("case 1:\ndefault:\nelse", dict(complexity=2)),
    "url.js": ('a = "http://x" && b', dict(complexity=2)),
    "dup_import.java": ("import a.B;\nimport a.B;\n", dict(imports=1)),
    "react.jsx": ("import x from 'y'", dict(imports=0)),
    "bare_import.java": ("import\nfoo bar", dict(imports=0)),
    "oneline_script.html": ("<script>a()</script>\nlet x = 1;\n", dict(boilerplate=1, logic_lines=1, lang="HTML")),
    "json_script.html": ('<script type="application/json">\nlet x = 1;\n', dict(logic_lines=0, code=2)),
    "commented_script.html": ("<!--\n<script>\nlet x;\n*/\ny\n</script>\n-->\nz", dict(boilerplate=2, comments=3, logic_lines=1, code=3)),
    "five.html": (JS_LINES, dict(lang="HTML+JS", logic_lines=5, quality_score=100, debt_score=0)),
    "pkg/__init__.py": ("", dict(is_exempt=True)),
    "tabs.c": ("\t\tx\n  \ty\n", dict(max_nesting=2)),
    "tab_after_spaces.c": ("  \ty\n", dict(max_nesting=1)),
    "crlf.js": ("a\r\nb\r", dict(total=2, code=2)),
    "rust.rs": ("match x { Some(v) => 1, None => else }", dict(complexity=4)),
    "lua.lua": ("if a and b then -- or\nelseif c then\nelse\nend", dict(complexity=4)),
    "php.php": ("if (a) { } # else\n// if", dict(complexity=2, comments=1)),
    "match_big.py": ("match x:\n" + "".join(f"    case {i}:\n        pass\n" for i in range(5)), dict(complexity=4)),
    "unicode_word.js": ("éif (x) ifé", dict(complexity=1)),
    "info_sep.js": ("\x1cx\x1f\n\u3000\n", dict(code=1, boilerplate=1)),
    "docstrings.py": ('"""m"""\ndef f():\n    """d"""\nclass C:\n    """ """\n', dict(docstrings=2)),
    "imports.py": ("import a, b\nfrom c import d\nimport a\n", dict(imports=4)),
    "try_star.py": ("try:\n    a\nexcept* ValueError:\n    b\n", dict(complexity=1)),
    "bom.py": ("\ufeffx = 1\n", dict(ast_ok=False)),
}


@pytest.fixture(scope="module")
def results(sources):
    rows = file_metrics(sources({path: content for path, (content, _) in GOLDEN.items()})).collect()
    return {row["path"]: row.asDict() for row in rows}


@pytest.mark.parametrize("path", GOLDEN)
def test_golden(results, path):
    expected = GOLDEN[path][1]
    assert {key: results[path][key] for key in expected} == expected


def test_every_line_has_one_class(results):
    for row in results.values():
        assert row["total"] == row["code"] + row["comments"] + row["boilerplate"]


def test_unreadable_file_scores_nothing(sources):
    row = file_metrics(sources({"gone.py": None})).first()
    assert (row["total"], row["complexity"], row["quality_score"], row["debt_score"]) == (0, 0, -1, 0)


def test_binary_content_drops_malformed_bytes_but_does_not_parse(sources):
    files = sources({"a.py": b"x = 1\xff\n", "b.py": b"x = 1\r\n", "c.py": "s = '\ufffd'\n".encode()})
    rows = {r["path"]: r for r in file_metrics(files).collect()}
    assert not rows["a.py"]["ast_ok"] and rows["a.py"]["code"] == 1
    assert rows["b.py"]["ast_ok"] and rows["c.py"]["ast_ok"]


def test_language_and_pruning(sources):
    files = sources({p: "" for p in (".py", "A.PY", "noext", "x.zzz", "build/a.py", "a/node_modules/b.js", "Build/a.py", "build")})
    assert {r["path"]: r["lang"] for r in files.collect()} == {".py": "Python", "A.PY": "Python", "Build/a.py": "Python"}


def test_long_texts_stay_linear(sources):
    files = sources(
        {
            "literal.js": 'a = "' + "x" * 200_000 + '"; b && c',
            "escapes.js": 'a = "' + "\\n" * 50_000 + '" && c',
            "many.js": "/* a\n*/\n" * 20_000,
            "blanks.java": " " * 50_000 + "\n",
        }
    )
    rows = {r["path"]: r for r in file_metrics(files).collect()}
    assert rows["literal.js"]["complexity"] == rows["escapes.js"]["complexity"] == 2
    assert rows["many.js"]["comments"] == 40_000
