"""Smell detectors: nine patterns, long lines and long functions, all in one pass per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from debtscope import dims
from debtscope.functions import regex as R, text as X
from debtscope.functions.stage import staged
from debtscope.operators.matches import first_mark_lines

SMELL_TYPE = (
    "struct<detector_no:int,key:string,count:int,lines:array<int>,formatted:array<string>,"
    "details:array<struct<name:string,length:int>>>"
)
#: Text that must occur for a pattern to match; spares most files the pattern itself.
_NEEDED = {
    "long_param_list": ("def", "func", "public", "private", "protected"),
    "print_debug": ("(",),
    "duplicate_string": ('"', "'"),
    "bare_except": ("except",),
    "todo_fixme": ("#", "//", "/*"),
    "commented_code": ("#", "//"),
    "hardcoded_path": ('"', "'"),
}
_REGEX_KEYS = [key for key in R.SMELL_PATTERNS if key != "deep_nesting"]
#: All detectors, and what can be told of a smell besides its count.
KEYS = ("deep_nesting", *_REGEX_KEYS, "long_lines", "long_function")
PARTS = ("lines", "formatted", "details")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _where_needed(key: str, found: Column) -> Column:
    """``found`` where the text can match at all, else null."""
    if key not in _NEEDED:
        return found
    present = F.lit(False)
    for piece in _NEEDED[key]:
        present = present | F.contains("smell_text", F.lit(piece))
    return F.when(present, found)


def _hits(key: str) -> Column:
    """How often a pattern matches."""
    return F.coalesce(_where_needed(key, F.size(F.regexp_extract_all("smell_text", F.lit(R.SMELL_PATTERNS[key]), F.lit(0)))), F.lit(0))


def _marks(key: str) -> Column:
    """The text with its matches marked; null where there can be none."""
    return _where_needed(key, X.marked(F.col("smell_text"), R.SMELL_PATTERNS[key]))


def _is_deep(line: Column) -> Column:
    """Whether a line is deeply nested; few lines start far enough to the right for the pattern."""
    far = F.startswith(line, F.lit(" " * 20)) | F.startswith(line, F.lit("\t" * 5))
    return far & F.rlike(line, F.lit(R.SMELL_PATTERNS["deep_nesting"]))


def _def_ranges() -> Column:
    """``(name, start, end)`` from one ``def`` line to the line before the next."""
    ends = lambda i: F.coalesce(F.get("def_starts", i + 1) - 1, F.size("advisor"))
    return F.transform(
        F.arrays_zip("def_names", "def_starts"),
        lambda d, i: F.struct(d["def_names"].alias("name"), d["def_starts"].alias("start"), ends(i).alias("end")),
    )


def _deep_rows(text: Column) -> Column:
    """``(func, line)`` of deeply nested lines; ``func`` is null above the first ``def``."""
    deep = F.lit(R.SMELL_PATTERNS["deep_nesting"])

    def of_piece(piece: Column, k: Column) -> Column:
        first = F.when(k == 0, 1).otherwise(F.get("def_starts", k - 1))
        func = F.get("def_names", k - 1)
        flagged = F.transform(F.split(piece, "\n", -1), lambda l, j: F.struct(_is_deep(l).alias("deep"), j.alias("j")))
        return F.transform(
            F.filter(flagged, lambda x: x["deep"]),
            lambda x: F.struct(F.when(k > 0, func).alias("func"), (first + x["j"]).cast("int").alias("line")),
        )

    rows = F.flatten(F.transform(F.split("def_marked", X.MARK, -1), of_piece))
    return F.when(F.rlike(text, deep), rows).otherwise(
        F.array().cast("array<struct<func:string,line:int>>")
    )


def _deep_lines(text: Column) -> Column:
    """Like :func:`_deep_rows` without the functions, so no ``def`` line is looked for."""
    deep = F.lit(R.SMELL_PATTERNS["deep_nesting"])
    flagged = F.transform(X.advisor_lines(text), lambda l, i: F.struct(_is_deep(l).alias("deep"), (i + 1).alias("line")))
    rows = F.transform(F.filter(flagged, lambda x: x["deep"]), lambda x: F.struct(x["line"].alias("line")))
    return F.when(F.rlike(text, deep), rows).otherwise(F.array().cast("array<struct<line:int>>"))


def merged_ranges(numbers: Column) -> Column:
    """``L4`` and ``L7-9`` for ascending distinct line numbers."""
    first = F.filter(numbers, lambda n, i: (i == 0) | (F.get(numbers, i - 1) != n - 1))
    last = F.filter(numbers, lambda n, i: (i == F.size(numbers) - 1) | (F.get(numbers, i + 1) != n + 1))
    return F.zip_with(
        first,
        last,
        lambda a, b: F.concat(
            F.lit("L"), a.cast("string"), F.when(a != b, F.concat(F.lit("-"), b.cast("string"))).otherwise("")
        ),
    )


def _formatted_deep(rows: Column) -> Column:
    """Up to five ``[function]ranges`` entries with two ranges each; lines outside functions last."""
    named = F.array_distinct(F.transform(F.filter(rows, lambda r: r["func"].isNotNull()), lambda r: r["func"]))
    outside = F.when(F.exists(rows, lambda r: r["func"].isNull()), F.array(F.lit(None).cast("string")))
    groups = F.slice(F.concat(named, F.coalesce(outside, _no_strings())), 1, 5)
    lines_of = lambda name: F.transform(
        F.filter(rows, lambda r: r["func"].eqNullSafe(name)), lambda r: r["line"]
    )
    gathered = F.transform(
        groups, lambda g: F.struct(g.alias("name"), F.array_sort(F.array_distinct(lines_of(g))).alias("lines"))
    )
    return F.transform(
        gathered,
        lambda g: F.concat(
            F.lit("["), F.coalesce(g["name"], F.lit("global")), F.lit("]"),
            F.array_join(F.slice(merged_ranges(g["lines"]), 1, 2), ","),
        ),
    )


def _smell(key: str, count: Column, lines=None, formatted=None, details=None) -> Column:
    number = next(no for no, name, *_ in dims.SMELLS if name == key)
    null = F.lit(None)
    parts = [
        F.lit(number).alias("detector_no"),
        F.lit(key).alias("key"),
        count.alias("count"),
        (null if lines is None else lines).alias("lines"),
        (null if formatted is None else formatted).alias("formatted"),
        (null if details is None else details).alias("details"),
    ]
    return F.when(count > 0, F.struct(*parts).cast(SMELL_TYPE))


def _with_defs(files: DataFrame) -> DataFrame:
    """Add the lines of ``smell_text`` and the places and names of its ``def`` lines.

    The arrays are read inside lambdas, so they are staged: Spark would otherwise be free to
    inline a column that is named once and compute it again for every element.
    """
    text = F.col("smell_text")
    some = F.contains(text, F.lit("def"))
    marked = files.withColumn("def_marked", F.when(some, X.marked(text, R.DEF_LINE)).otherwise(text))
    names = F.regexp_extract_all(text, F.lit(R.DEF_LINE), F.lit(1))
    return staged(
        marked,
        [*files.columns, "def_marked"],
        advisor=X.advisor_lines(text),
        def_starts=F.when(some, X.mark_lines(F.split("def_marked", "\n", -1))).otherwise(F.array().cast("array<int>")),
        def_names=F.when(some, names).otherwise(_no_strings()),
    )


def with_smells(files: DataFrame, keys: Sequence[str] = KEYS, parts: Sequence[str] = PARTS) -> DataFrame:
    """Add ``smells``: an array in detector order, empty where nothing was found.

    Only the detectors in ``keys`` run, and of each smell only the count and ``parts`` are told; the others are null.
    """
    text, patterns = F.col("smell_text"), [key for key in _REGEX_KEYS if key in keys]
    scanned, lined = files.withColumn("smell_text", F.coalesce("text", F.lit(""))), "lines" in parts
    scanned = scanned.withColumns({f"hits_{key}": _marks(key) if lined else _hits(key) for key in patterns})
    placed = "formatted" in parts and "deep_nesting" in keys
    if placed or "long_function" in keys:
        scanned = _with_defs(scanned)
    elif "long_lines" in keys:
        scanned = scanned.withColumn("advisor", X.advisor_lines(text))
    own = {}
    if "deep_nesting" in keys:
        own["deep_rows"] = _deep_rows(text) if placed else _deep_lines(text)
    if "long_lines" in keys:
        numbered = F.transform("advisor", lambda line, i: F.struct((i + 1).alias("n"), (F.length(line) > dims.LONG_LINE).alias("long")))
        own["long_lines"] = F.transform(F.filter(numbered, lambda x: x["long"]), lambda x: x["n"])
    if "long_function" in keys:
        own["long_functions"] = F.filter(_def_ranges(), lambda r: r["end"] - r["start"] > dims.LONG_FUNCTION)
    ready = scanned.withColumns(own)
    told = lambda part, value: value if part in parts else None
    found = []
    if "deep_nesting" in keys:
        deep = F.col("deep_rows")
        lines = F.slice(F.transform(deep, lambda r: r["line"]), 1, 5)
        found.append(_smell("deep_nesting", F.size(deep), told("lines", lines), told("formatted", _formatted_deep(deep) if placed else None)))
    for key in patterns:
        hits = F.col(f"hits_{key}")
        count = F.coalesce(F.length(hits) - F.length(text), F.lit(0)) if lined else hits  # a mark is one character
        found.append(_smell(key, count, told("lines", first_mark_lines(hits, count, 5) if lined else None)))
    if "long_lines" in keys:
        found.append(_smell("long_lines", F.size("long_lines"), told("lines", F.slice("long_lines", 1, 5))))
    if "long_function" in keys:
        longest = F.slice("long_functions", 1, 3)
        details = F.transform(longest, lambda r: F.struct(r["name"].alias("name"), (r["end"] - r["start"]).alias("length")))
        starts = F.transform(longest, lambda r: r["start"])
        found.append(_smell("long_function", F.size("long_functions"), told("lines", starts), details=told("details", details)))
    return staged(ready, files.columns, smells=F.array_compact(F.array(*found)))


def smell_rows(files: DataFrame, keys: Sequence[str] = KEYS, parts: Sequence[str] = PARTS) -> DataFrame:
    """``file_id`` and one row per smell found; see :func:`with_smells`."""
    return with_smells(files.select("file_id", "text"), keys, parts).select("file_id", F.inline("smells"))


def def_range_rows(files: DataFrame) -> DataFrame:
    """``file_id, name, start, end`` of the ranges that smell locations refer to."""
    some = files.filter(F.contains("text", F.lit("def"))).select("file_id", F.col("text").alias("smell_text"))
    return _with_defs(some).select("file_id", F.inline(_def_ranges()))


def deep_line_rows(files: DataFrame) -> DataFrame:
    """``file_id, line, func`` of deeply nested lines, with the enclosing function."""
    deep = files.filter(F.rlike("text", F.lit(R.SMELL_PATTERNS["deep_nesting"])))
    located = _with_defs(deep.select("file_id", F.col("text").alias("smell_text")))
    return located.select("file_id", F.inline(_deep_rows(F.col("smell_text"))))
