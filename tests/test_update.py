"""Profiles kept up to date, and contents measured once."""

import pytest

from debtscope.operators import rollup
from debtscope.plans import update
from debtscope.plans.profile_table import profile, read_profile

PYTHON = "def f(a):\n    if a and a:\n        print(a)\n"
FILES = {f"src/f{i}.{ext}": PYTHON + f"x = {i}\n" for i, ext in enumerate(["py", "js", "go", "md"] * 4)}


@pytest.fixture()
def corpus(spark):
    def build(contents, repo="r"):
        return spark.createDataFrame([(repo, path, text) for path, text in contents.items()], "repo string, path string, content string")

    return build


def rows(frame):
    return sorted((str(sorted(r.asDict(recursive=True).items())) for r in frame.collect()))


def test_update_equals_a_fresh_profile(corpus, spark, tmp_path):
    before = {**FILES, "gone.py": "x = 1\n", "bad.py": None, "build/no.py": "y"}
    after = {**FILES, "src/f0.py": "y = 2\n", "new.js": "let a = 1;\n", "bad.py": None, "build/no.py": "z"}
    old = update.write_digested(corpus(before), f"{tmp_path}/before")
    new = update.update_profile(corpus(after), f"{tmp_path}/before", f"{tmp_path}/after", f"{tmp_path}/work")
    assert rows(new) == rows(profile(update.with_digest(corpus(after)), "digest"))
    assert spark.read.parquet(f"{tmp_path}/work/changed").count() == 2  # texts measured
    gone, came = update.changes(old, new)
    assert sorted(r["path"] for r in gone.collect()) == ["gone.py", "src/f0.py"]
    assert sorted(r["path"] for r in came.collect()) == ["new.js", "src/f0.py"]
    merged = update.merged_rollup(rollup.language_rollup(old), gone, came)
    assert rows(merged) == rows(rollup.language_rollup(new).select(merged.columns))


def test_a_language_without_files_leaves_the_rollup(corpus, tmp_path):
    old = update.write_digested(corpus({"a.py": "x\n", "b.go": "y\n"}), f"{tmp_path}/before")
    new = update.update_profile(corpus({"a.py": "x\n"}), f"{tmp_path}/before", f"{tmp_path}/after", f"{tmp_path}/work")
    merged = update.merged_rollup(rollup.language_rollup(old), *update.changes(old, new))
    assert [r["lang"] for r in merged.collect()] == ["Python"]


def test_known_digests_spare_the_texts(corpus, spark, tmp_path):
    files = update.with_digest(corpus(FILES))
    files.write.parquet(f"{tmp_path}/files")
    stored = spark.read.parquet(f"{tmp_path}/files")
    plan = update._named(update.with_digest(stored)).select("file_id", "digest")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    update.write_digested(stored, f"{tmp_path}/before")
    again = update.update_profile(stored, f"{tmp_path}/before", f"{tmp_path}/after", f"{tmp_path}/work")
    assert spark.read.parquet(f"{tmp_path}/work/changed").isEmpty() and rows(again) == rows(read_profile(spark, f"{tmp_path}/before"))


def test_each_content_is_measured_once(corpus, spark, tmp_path):
    contents = {f"lib{i}/v.{ext}": PYTHON for i in range(30) for ext in ("py", "js")} | {"a/__init__.py": PYTHON, "b/n.py": None, "c/n.py": None}
    files = corpus(contents)
    once = update.profile_contents(files, f"{tmp_path}/work")
    assert rows(once) == rows(profile(files).select(once.columns))
    assert spark.read.parquet(f"{tmp_path}/work/contents").count() == 3  # Python, JavaScript and the unreadable one
