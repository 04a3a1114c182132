"""Per-file metrics and scores: one map-only pass over the corpus.

Counts are taken from the line classes of :mod:`debtscope.operators.lines`; complexity and
imports come from regular expressions over the joined logic lines, or from the syntax nodes
where a Python file parses.  The result holds one narrow row per file, which is all that the
rollups, rankings and reports shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from debtscope.functions import regex as R, scores as S, text as X
from debtscope.functions.stage import staged
from debtscope.operators import lines as L, syntax

METRIC_COLUMNS = [
    "file_id", "repo", "path", "lang", "is_logic", "is_exempt", "ast_ok", "total", "code", "comments",
    "boilerplate", "logic_lines", "imports", "max_nesting", "complexity", "docstrings", "debt_score",
    "quality_score",
]


#: The measures that a score or label is made of.
_MADE_OF = {
    "lang": ("lang", "html", "logic_lines"),
    "debt_score": ("readable", "logic_lines", "total", "comments", "imports", "complexity", "max_nesting"),
    "quality_score": ("readable", "logic_lines", "total", "comments", "complexity"),
}


def sanitized(text: Column, lang: Column) -> Column:
    """Blank string literals, then cut inline comments, on every line of ``text``."""
    blanked = F.regexp_replace(text, F.lit(R.LITERAL), F.lit('""'))
    cut = F.when(lang == "PHP", F.regexp_replace(blanked, F.lit(R.INLINE_COMMENT["PHP"]), F.lit("")))
    cut = cut.when(lang == "Lua", F.regexp_replace(blanked, F.lit(R.INLINE_COMMENT["Lua"]), F.lit("")))
    return cut.otherwise(F.regexp_replace(blanked, F.lit(R.INLINE_COMMENT[None]), F.lit("")))


def branch_words(clean: Column, family: Column) -> Column:
    """Every branch keyword and operator of the family."""
    found = None
    for name, pattern in R.BRANCHES.items():
        hits = F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
        found = F.when(family == name, hits) if found is None else found.when(family == name, hits)
    return found.otherwise(F.array().cast("array<string>"))


def branch_weight(words: Column) -> Column:
    """One per branch, one half for case, default and else."""
    halves = F.filter(words, lambda word: word.isin(*R.HALF_BRANCHES))
    return F.size(words) - F.size(halves) * F.lit(0.5)


def import_lines(text: Column, kind: Column) -> Column:
    """Distinct import lines among newline-joined stripped lines."""
    found = None
    for name, pattern in R.IMPORTS.items():
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found = F.when(kind == name, hits) if found is None else found.when(kind == name, hits)
    return F.array_distinct(found.otherwise(F.array().cast("array<string>")))


def with_logic_text(files: DataFrame) -> DataFrame:
    """Add the syntax nodes, the logic lines and their joined text.

    Logic lines are the code lines of a logic language and the script lines of HTML.  The text
    is empty where the syntax tree is used instead.
    """
    parsed = files.withColumn("nodes", syntax.syntax_nodes("strict_text"))
    lined = L.with_line_arrays(parsed).withColumn("ast_ok", F.col("nodes").isNotNull())
    is_html = F.col("lang") == "HTML"
    wanted = F.when(is_html, "kp").when(F.col("is_logic"), "KP").otherwise("")
    logic = F.filter(F.arrays_zip("lines", "stripped", "kinds"), lambda x: F.contains(wanted, x["kinds"]))
    picked = lined.withColumn("logic", logic).withColumns(
        {
            "family": F.when(is_html, "C-Family").otherwise(F.col("family")),
            "import_kind": F.when(is_html, "script").otherwise(F.col("import_kind")),
        }
    )
    text = F.when(~F.col("ast_ok"), F.array_join(F.col("logic.stripped"), "\n")).otherwise("")
    return picked.withColumn("logic_text", text)


def with_branches(files: DataFrame) -> DataFrame:
    """Add ``words``, the branch words of the logic text, and ``import_lines``."""
    clean = sanitized(F.col("logic_text"), F.col("lang"))
    return files.withColumn("words", branch_words(clean, F.col("family"))).withColumn(
        "import_lines", import_lines(F.col("logic_text"), F.col("import_kind"))
    )


def measured(files: DataFrame, carry: list[str] | None = None, only: set[str] | None = None) -> DataFrame:
    """Raw measures per file before scoring; ``carry`` names further columns to keep, ``only`` the measures to take."""
    carry = carry or []
    worded = with_branches(with_logic_text(files)).withColumn("class_string", F.upper(F.array_join("kinds", "")))
    scan = ~F.col("ast_ok")
    deepest = F.coalesce(F.array_max(F.transform(F.col("logic.lines"), X.indent_level)), F.lit(0))
    readable = F.col("text").isNotNull()
    found = F.when(F.col("ast_ok"), syntax.complexity(F.col("nodes"))).otherwise(
        (F.lit(1.0) + branch_weight(F.col("words"))).cast("int")
    )

    def lines_of(*kinds: str) -> Column:
        count = F.lit(0)
        for kind in kinds:
            count = count + X.occurrences(F.col("class_string"), kind)
        return count.cast("int")

    measures = dict(
        html=F.col("lang") == "HTML",
        lang=F.col("lang"),
        ast_ok=F.col("ast_ok"),
        readable=readable,
        total=F.size("lines"),
        code=lines_of("K"),
        comments=lines_of("C"),
        boilerplate=lines_of("T", "B", "P"),
        logic_lines=F.size("logic"),
        imports=F.when(F.col("ast_ok"), syntax.imports(F.col("nodes"))).otherwise(F.size("import_lines")),
        max_nesting=F.when(scan, deepest).otherwise(0),
        complexity=F.when(readable, found).otherwise(0),
        docstrings=F.coalesce(syntax.docstrings(F.col("nodes")), F.lit(0)),
    )
    taken = {name: value for name, value in measures.items() if only is None or name in only}
    return staged(worded, ["file_id", "repo", "path", "is_logic", "is_exempt", *carry], **taken)


def file_metrics(files: DataFrame, carry: list[str] | None = None, only: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """``file_metrics``: measures, scores and flags, one row per source file; of them those named by ``only``, and no others are worked out."""
    carry = carry or []
    wanted = {part for name in only for part in _MADE_OF.get(name, (name,))}
    m = measured(files, carry, wanted)
    args = dict(is_logic=F.col("is_logic"), logic_lines=F.col("logic_lines"), total=F.col("total"), comments=F.col("comments"))
    made = {}
    if "lang" in only:
        made["lang"] = F.when(F.col("html") & (F.col("logic_lines") >= 5), "HTML+JS").otherwise(F.col("lang"))
    if "debt_score" in only:
        debt = S.debt_score(**args, imports=F.col("imports"), complexity=F.col("complexity"), max_nesting=F.col("max_nesting"))
        made["debt_score"] = F.when(F.col("readable"), debt).otherwise(0)
    if "quality_score" in only:
        quality = S.quality_score(**args, complexity=F.col("complexity"))
        made["quality_score"] = F.when(F.col("readable"), quality).otherwise(-1)
    return m.withColumns(made).select(*[name for name in METRIC_COLUMNS if name in only], *carry)
