"""Code templates that turn table rows into source files.

Each row of ``lineitem`` becomes one template of its file's language family, so a corpus of
any size can be derived from the given tables.  ``@`` stands for a token made of the row's
key; every template with quotes has one behind its last quote, which keeps quoted text from
repeating across rows.  The weights are written by hand and are used only to check results:
``magic`` and ``duplicate`` are smell counts, ``nodes`` lists (kind, arity, docstring, n).
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    family: str
    k: int
    body: str
    magic: int = 0
    duplicate: int = 0
    nodes: tuple = ()


def _family(name: str, *rows: tuple) -> list[Template]:
    return [Template(name, k, *(row if isinstance(row, tuple) else (row,))) for k, row in enumerate(rows)]


def _node(kind: str, arity: int = 1, docstring: bool = False, n: int = 1) -> tuple:
    return (kind, arity, docstring, n)


_FUNCTION = _node("FunctionDef")
_LONG_PARAMS = ", ".join(f"parameter_{c}" for c in "abcdefgh")

_PYTHON = _family(
    "py",
    ("import os, sys", 0, 0, (_node("Import", 2),)),
    ("from a.b import c, d, e", 0, 0, (_node("ImportFrom", 3),)),
    ("x = 12345", 1),
    ("if x > 10:\n    y = 20\nelif x:\n    y = 30", 3, 0, (_node("If", n=2),)),
    ("for i in range(10):\n    pass", 1, 0, (_node("For"),)),
    "# TODO: later",
    ("z = 1 if x else 2", 0, 0, (_node("IfExp"),)),
    ("w = [a for a in range(3) if a and x]", 0, 0, (_node("ListComp", 2), _node("BoolOp", 2))),
    "",
    (
        'def f_a(a, b):\n    """Doc."""\n    if a and b or x:\n        return 1\n    return @', 0, 0,
        (_node("FunctionDef", docstring=True), _node("If"), _node("BoolOp", 2, n=2)),
    ),
    ("try:\n    g()\nexcept:\n    pass", 0, 0, (_node("Try"),)),
    (
        "match x:\n    case 1:\n        pass\n    case 2:\n        pass\n    case 3:\n        pass\n"
        "    case 4:\n        pass\n    case 5:\n        pass", 0, 0, (_node("Match", 5),),
    ),
    ("match x:\n    case 1:\n        pass\n    case 2:\n        pass", 0, 0, (_node("Match", 2),)),
    ("class K_a:\n    def m(self):\n        return self.v", 0, 0, (_node("ClassDef"), _FUNCTION)),
    ("async def g_b(x):\n    async for i in x:\n        print(i)", 0, 0, (_node("AsyncFunctionDef"), _node("AsyncFor"))),
    'v = """\nblock text\n\nmore text\n""" + @',
    'p = "/usr/lib" + @',
    ('k = "duplicate text" + "duplicate text" + @', 0, 1),
    "# return value",
    (
        "if a:\n    if b:\n        if c:\n            if d:\n                if e:\n                    deep()\n"
        "                    deeper()", 0, 0, (_node("If", n=5),),
    ),
    ("q = {a: b for a in c if a if b}", 0, 0, (_node("DictComp", 3),)),
    (f"def long_p({_LONG_PARAMS}):\n    pass", 0, 0, (_FUNCTION,)),
    ("while x:\n    x = not x", 0, 0, (_node("While"),)),
    ("def long_fn(a):\n" + "    a += 1\n" * 54 + "    return a", 0, 0, (_FUNCTION,)),
    (
        "def busy_fn(a):\n" + "    if a and b:\n        a = c\n" * 8 + "    return a", 0, 0,
        (_FUNCTION, _node("If", n=8), _node("BoolOp", 2, n=8)),
    ),
)

_C_LIKE = _family(
    "cl",
    "import java.util.@;",
    "import React from react;",
    "#include <stdio.h>",
    "use App\\Models\\User;",
    ("int x = 12345;", 1),
    ("if (x > 10 && y) {\n    x = 20;\n} else {\n    y = 0;\n}", 2),
    "// TODO: later",
    "/* block\n * more\n\n */",
    'b &&"http://x" || @;',
    "x = 1 /* y */",
    ("function doThing(a, b) {\n\tfor (;;) {\n\t\tif (a && b) { return 77; }\n\t}\n}", 1),
    "public static int compute(int a) {\n    switch (a) {\n        case 1: break;\n        default: a = b&&c;\n    }\n}",
    "}",
    "",
    "                    deep();",
    'p = "/usr/lib" + @',
    "print(x); console.log(y);",
    "# return value",
    ('k = "duplicate text" + "duplicate text" + @', 0, 1),
    "  \tint t = a ? b : c;",
    (
        "function longFn(a) {\n" + "    a++;\n" * 33 + '    s = "}" + @;\n}'
    ),
    (
        "static void busyFn(int a) {\n" + "    if (a > 1 && b) { a--; } else { a++; }\n" * 9 + "}"
    ),
    "const add = (a, b) => {\n    try { go(); } catch (e) { }\n}",
    "class Widget {",
    "private String name(int a, int b) {\n    while (a) { a--; }\n    return b;\n}",
    "fun calc(a: Int) {\n    a = 0x1F2E\n}",
    "".join("    " * level + "if (a) {\n" for level in range(8)) + "    " * 8 + "b();\n" + "}" * 8,
)
_C_LIKE[25] = _C_LIKE[25]._replace(magic=1)

_GO = _family(
    "go",
    'import "fmt" // @',
    "func main() {\n\tgo(a)\n}",
    "func (r *T) Do(a int) error {\n\tif a > 0 && r != nil {\n\t\treturn nil\n\t}\n\treturn err\n}",
    ("switch x {\ncase 15:\n\ty()\ndefault:\n}", 1),
    "if a || b {\n} else {\n}",
    "// FIXME this",
    "/* a\nb */",
    "fmt.Print(x)",
    "select {\n}",
    "",
    "}",
    "func longGo(a int) {\n" + "\ta++\n" * 32 + "}",
)

_RUST = _family(
    "rs",
    "use std::io;",
    "mod @;",
    "pub use b::c;",
    "extern crate z;",
    "/// doc",
    "//! inner",
    "match x {\n    Some(v) => v,\n    None => 0,\n}",
    "pub fn go(a: i32) -> i32 {\n    a\n}",
    "fn two<'a>(x: &'a str) { // @\n}",
    "pub struct S {",
    "}",
    "loop {\n    if a && b { Ok(c) } else { Err(d) }\n}",
    "/* c */",
    "",
    "fn long_rs(a: u8) {\n" + "    a + 1;\n" * 33 + "}",
)

_LUA = _family(
    "lua",
    "-- c",
    "--[[ open\ntext\n]] close",
    "--[[ x ]]",
    "local function f(a)\n    return a\nend",
    "if a and b then\n    c()\nelseif c or d then\n    d()\nelse\n    e()\nend",
    ("for i=1,10 do\n    a = i -- or\nend", 1),
    's = "or -- x" or @',
    "g = function(x)",
    "repeat",
    "",
    "x = 1 --[[ open",
)

_RUBY = _family(
    "rb",
    "=begin\ncomment\n=end",
    "# c",
    "def go\n  puts 1\nend",
    "require 'a' + @",
    "",
    "x = 1 =begin",
    ("y = 42", 1),
)

_HTML = _family(
    "html",
    "<div>",
    "<script>",
    "</script>",
    '<script src="a.js"></script> @',
    '<script type="application/json"> @',
    '<SCRIPT TYPE="module"> @',
    "<script>a()</script>",
    "<!-- note",
    "-->",
    "<!-- one -->",
    "if (a && b) { go(); } else { stop(); }",
    "/* js",
    "*/",
    "// c",
    "import x from 'y' @",
    "",
    "<p>text</p>",
    "\t\t  var a = 1;",
    "}",
    "<script data-src=x>",
    "</script >",
)

_CSS = _family(
    "css",
    ".a { color: red; }",
    "/* c",
    "*/",
    "/* x */",
    "// scss",
    "",
    "}",
    "  margin: 10px;",
    ("width: 100;", 1),
)

_MARKDOWN = _family(
    "md",
    "# Title",
    "<!-- hidden",
    "-->",
    ("text with 2024 words", 1),
    "",
    "- item",
    "<!-- x -->",
    "long " * 30 + "line",
)

_SHELL = _family(
    "sh",
    "# c",
    "<# block",
    "#>",
    "echo hi",
    "if [ -f x ]; then",
    "",
    "}",
    "# TODO fix",
    "// hack",
    "cp a /tmp/b",
)

TEMPLATES = _PYTHON + _C_LIKE + _GO + _RUST + _LUA + _RUBY + _HTML + _CSS + _MARKDOWN + _SHELL
FAMILY_SIZES = {name: sum(t.family == name for t in TEMPLATES) for name in dict.fromkeys(t.family for t in TEMPLATES)}

#: Extension by ``file_id % 29``; the common ones occur twice.
EXTENSIONS = [
    "py", "js", "ts", "jsx", "tsx", "java", "c", "cpp", "h", "hpp", "cs", "go", "rs", "kt", "kts", "rb", "php",
    "lua", "html", "css", "scss", "md", "sh", "ps1", "py", "js", "java", "html", "py",
]
_OWN_FAMILY = {"py": "py", "go": "go", "rs": "rs", "lua": "lua", "rb": "rb", "html": "html", "css": "css",
               "scss": "css", "md": "md", "sh": "sh", "ps1": "sh"}
FAMILY_OF_EXTENSION = {ext: _OWN_FAMILY.get(ext, "cl") for ext in dict.fromkeys(EXTENSIONS)}
EXEMPT_NAME_OF_EXTENSION = {"py": "__init__.py", "js": "index.js", "ts": "index.ts", "rs": "mod.rs", "go": "package.go"}
