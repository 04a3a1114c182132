"""Line states against a plain walk over the lines, on random texts."""

import random

import pytest

from debtscope import dims
from debtscope.operators.lines import line_rows

PIECES = {
    "py": ['"""', "'''", "# c", "x", "", "  ", "}"],
    "js": ["/*", "*/", "// c", "x", "", "/*/", "}"],
    "lua": ["--[[", "]]", "-- c", "x", ""],
    "rb": ["=begin", "=end", "# c", "x", ""],
    "ps1": ["<#", "#>", "# c", "x", ""],
    "sh": ["# c", "x", "<#", ""],
    "html": ["<!--", "-->", "/*", "*/", "// c", "<script>", "</script>", "<script src=a>", "x", "", "}"],
}


def expected_kinds(ext, lines):
    _, _, singles, starts, ends, *_ = next(row for row in dims.LANGUAGES if row[0] == ext)
    script, block, out = False, False, []
    for line in lines:
        text = line.strip()
        if ext == "html" and "<script>" in line:
            script = True
            out.append("T")
        elif ext == "html" and "</script>" in line:
            script = False
            out.append("T")
        else:
            begin, end, one = (["/*"], ["*/"], ["//"]) if script else (starts, ends, singles)
            opener = next((t for t in begin if t in text), None)
            if not text:
                out.append("B")
            elif block:
                block = not any(t in text for t in end)
                out.append("C")
            elif opener:
                block = not any(t in text.split(opener, 1)[1] for t in end)
                out.append("C")
            else:
                comment = text.startswith(tuple(one)) if one else False
                out.append("C" if comment else "P" if text in list("{}[]();,") else "K")
    return "".join(out)


@pytest.mark.parametrize("ext", PIECES)
def test_kinds_match_a_plain_walk(sources, ext):
    rng = random.Random(ext)
    texts = {}
    for i in range(120):
        lines = [" ".join(rng.choices(PIECES[ext], k=rng.choice([1, 1, 1, 2, 3]))) for _ in range(rng.randint(1, 25))] + ["end"]
        texts[f"f{i}.{ext}"] = lines
    rows = line_rows(sources({path: "\n".join(lines) for path, lines in texts.items()})).orderBy("file_id", "n").collect()
    found = {}
    for row in rows:
        found[row["file_id"]] = found.get(row["file_id"], "") + row["kind"]
    assert found == {path: expected_kinds(ext, lines) for path, lines in texts.items()}
