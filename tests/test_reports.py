"""Directory reader, profile table and report sinks end to end."""

import csv
import glob
import os

import pytest

from debtscope import dims
from debtscope.plans import advice, report
from debtscope.plans.profile_table import read_profile, write_profile
from debtscope.sources import tables
from debtscope.sources.corpus import list_directory, read_corpus, read_directory

BUSY = "def busy(a):\n" + "    if a and b:\n        print(a)\n" * 12 + "x = 4711  # TODO: name\n"


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {"pkg/__init__.py": b"x = 1\n", "pkg/busy.py": BUSY.encode(), "_priv/.hidden.js": b"a && b\r\n", "bad.py": b"x = 1\xff\n",
             "build/skip.py": b"x = 1\n", "notes.md": b"plain\n"}
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    rows = [("r", str(root), name) for name in [*files, "gone.py"]]
    return read_directory(spark.createDataFrame(rows, "repo string, root string, path string"))


@pytest.fixture(scope="module")
def profiled(tree, tmp_path_factory):
    return write_profile(tree, str(tmp_path_factory.mktemp("out") / "profile"))


def test_directory_reader_keeps_hidden_and_dunder_names(profiled):
    rows = {r["path"]: r for r in profiled.collect()}
    assert set(rows) == {"pkg/__init__.py", "pkg/busy.py", "_priv/.hidden.js", "bad.py", "notes.md", "gone.py"}
    assert rows["pkg/__init__.py"]["is_exempt"] and rows["pkg/__init__.py"]["ast_ok"]
    assert rows["gone.py"]["total"] == 0 and rows["gone.py"]["quality_score"] == -1
    assert not rows["bad.py"]["ast_ok"] and rows["_priv/.hidden.js"]["complexity"] == 2


def test_profile_row(profiled):
    row = profiled.filter("path = 'pkg/busy.py'").first()
    assert row["complexity"] == 25 and [f["name"] for f in row["functions"]] == ["busy"]
    assert [(s["key"], s["count"]) for s in row["smells"]] == [("magic_number", 1), ("print_debug", 12), ("todo_fixme", 1)]


def test_corpus_reader_builds_a_key(spark, tmp_path):
    rows = [("r", "a.py", "x = 1"), ("r2", "a.py", "x = 1")]
    spark.createDataFrame(rows, "repo string, path string, content string").write.parquet(str(tmp_path / "c"))
    assert read_corpus(spark, str(tmp_path / "c")).select("file_id").distinct().count() == 2


def test_csv_report(profiled, tmp_path):
    report.export(profiled.coalesce(1), str(tmp_path / "r.csv"), locale="en")
    (part,) = glob.glob(str(tmp_path / "r.csv" / "part-*"))
    rows = list(csv.DictReader(open(part, encoding="utf-8")))
    assert list(rows[0]) == ["File Path", "Language", "Debt Score", "Quality Score", "Complexity", "Type", "Lines", "Code", "Comments", "Imports"]
    assert rows[0]["File Path"] == "pkg/busy.py" and rows[0]["Type"] == "AST"
    assert {r["Quality Score"] for r in rows if r["File Path"] in ("notes.md", "gone.py")} == {"--"}


@pytest.mark.parametrize("locale", ["en", "zh"])
def test_text_report_with_advice(profiled, tmp_path, locale):
    report.export(profiled, str(tmp_path / "report"), locale=locale, include_advice=True)
    text = "\n".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(str(tmp_path / "report" / "part-*"))))
    title = {"en": "# Code Quality Report", "zh": "# 代码质量报告"}[locale]
    assert text.startswith(title)
    order = ["| `pkg/busy.py` | Python | 23 |", "### 📄 `pkg/busy.py`", "| `busy()` | L1 | 25 | 24 | 2 |", "× 12 [L3, L5, L7...]", "---"]
    places = [text.index(piece) for piece in order[:-1]]
    assert places == sorted(places)


def test_reported_files_need_something_to_say(profiled):
    assert [r["path"] for r in advice.reported(profiled).collect()] == ["pkg/busy.py"]


def test_top_file_advice_lines(profiled):
    lines = [r["line"] for r in advice.top_file_advice(profiled).collect()]
    start = lines.index("📄 pkg/busy.py (Debt Score: 23)")
    assert lines[start + 1 : start + 4] == [
        "  ▼ Complexity hotspot functions:",
        "    🔥 busy() [L1] CC=25, 24 lines, nesting 2",
        "      └ Split into several functions with one responsibility each",
    ]
    assert "    ⚠ Debug Code Residue × 12 [L3, L5, L7...]" in lines


def test_read_profile(spark, profiled, tmp_path):
    profiled.write.parquet(str(tmp_path / "p"))
    assert read_profile(spark, str(tmp_path / "p")).count() == 6


def test_directory_lister_equals_a_plain_walk(spark, tmp_path):
    names = ["a.py", "_x/.hid.js", "p/__init__.py", "p/q/r/s/deep.py", "build/no.py", "p/node_modules/no.js", "p/q/r/.git/no", "p/q/build.py", "p/q/r/s/t/u.c"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "p" / "empty").mkdir()
    roots = spark.createDataFrame([("r", str(tmp_path)), ("gone", str(tmp_path / "none"))], "repo string, root string")
    expected = []
    for folder, below, files in os.walk(tmp_path):
        below[:] = [d for d in below if d not in dims.IGNORED_DIRS]
        expected += [os.path.relpath(os.path.join(folder, f), tmp_path) for f in files]
    found = list_directory(roots).collect()
    assert sorted(r["path"] for r in found) == sorted(expected) and {r["repo"] for r in found} == {"r"}
    assert {r["path"] for r in read_directory(list_directory(roots)).collect()} == set(expected)


def test_a_missing_locale_falls_back_to_english(profiled):
    for report_of in (advice.report_sections, advice.top_file_advice):
        english, other = (sorted(map(tuple, report_of(profiled, locale=x).collect()), key=repr) for x in ("en", "fr"))
        assert english and english == other


def test_repeated_line_items_are_kept(spark, tmp_path):
    rows = tables.table(spark, "/root/testdata/sf0.001", "lineitem").select(*tables.KEYS).limit(1).collect()
    contents = []
    for times in (1, 3):
        spark.createDataFrame(rows * times).write.parquet(f"{tmp_path}/{times}/lineitem.parquet")
        contents.append(tables.code_files(spark, f"{tmp_path}/{times}").first()["content"])
    assert contents[1] == "\n".join([contents[0]] * 3)
