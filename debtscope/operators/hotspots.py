"""Functions and classes per file, with length, complexity and nesting of each function.

The text is cut at the function matches of its language; a function's piece runs from its
match to the next one.  Ends are found inside the piece (braces) or on the following 200
lines (indentation), so a file costs one scan plus work linear in its functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from debtscope.functions import openings as O, regex as R, text as X
from debtscope.functions.stage import staged

MIN_LENGTH = 30
MIN_COMPLEXITY = 10
_LOOK_AHEAD = 200
_FALLBACK_LENGTH = 100
#: Blank lines and ``#`` lines never end an indented function.
_SKIPPED_LINE = R.rx(r"^\s*(?:#|\z)")
#: What can be told of a function besides line and length.
PARTS = ("name", "complexity", "nesting")
FUNCTION_TYPE = "array<struct<name:string,line:int,length:int,complexity:int,nesting:int>>"


def _per_extractor(choose, otherwise: Column, keys=None) -> Column:
    result = None
    for key in keys or R.FUNCTION_PATTERNS:
        hit = F.col("extractor") == key
        result = F.when(hit, choose(key)) if result is None else result.when(hit, choose(key))
    return result.otherwise(otherwise)


def _function_name(piece: Column) -> Column:
    def named(key: str) -> Column:
        groups = [
            F.nullif(F.regexp_extract(piece, R.FUNCTION_PATTERNS[key], no), F.lit(""))
            for no in range(1, R.FUNCTION_NAME_GROUPS.get(key, 1) + 1)
        ]
        return F.coalesce(*groups)

    return _per_extractor(named, F.lit(None).cast("string"))


def _indented_length(piece: Column, start: Column) -> Column:
    """Lines to the first shallower line that is neither blank nor a ``#`` line.

    Only spaces count as indentation, the line right after the definition is not looked at,
    and without such a line within reach the function is taken to end after 100 lines.
    """
    own = F.length(piece) - F.length(F.ltrim(piece))

    def dedents(line: Column) -> Column:
        depth = F.length(line) - F.length(F.ltrim(line))
        return (depth <= own) & ~F.rlike(line, F.lit(_SKIPPED_LINE))

    ahead = F.slice("advisor", start + 2, F.lit(_LOOK_AHEAD - 1))
    ends = F.transform(ahead, lambda line, i: F.when(dedents(line), i + 1))
    first = F.get(F.filter(ends, lambda end: end.isNotNull()), F.lit(0))
    return F.coalesce(first, F.least(F.lit(_FALLBACK_LENGTH), F.size("advisor") - start))


def _braced_length(piece: Column) -> Column:
    """Lines to the first closing brace that returns to depth zero, else to the piece's end."""
    stretches = F.regexp_extract_all(piece, F.lit(R.BRACE_STRETCHES), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lines"), F.lit(-1).alias("end"))

    def brace(stretch: Column, which: str) -> Column:
        # no plain text has a quote or an escape, so a stretch with one does not end in a brace of its own
        other = F.contains(stretch, F.lit('"')) | F.contains(stretch, F.lit("'")) | F.contains(stretch, F.lit("\\"))
        return F.endswith(stretch, F.lit(which)) & ~other

    def step(acc: Column, stretch: Column) -> Column:
        depth = acc["depth"] + F.when(brace(stretch, "{"), 1).when(brace(stretch, "}"), -1).otherwise(0)
        lines = acc["lines"] + X.occurrences(stretch, "\n")
        closes = (depth == 0) & (acc["depth"] == 1)
        ahead = F.struct(depth.alias("depth"), lines.alias("lines"), F.when(closes, lines).otherwise(-1).alias("end"))
        return F.when(acc["end"] < 0, ahead).otherwise(acc)

    end = F.aggregate(stretches, start, step, lambda acc: F.when(acc["end"] >= 0, acc["end"]))
    return F.coalesce(F.when(F.contains(piece, F.lit("}")), end), X.occurrences(piece, "\n"))


def _pieces(files: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    clean = staged(files, files.columns, clean=O.cleaned(X.unmarked(text)))
    marked = _per_extractor(lambda key: O.marked(F.col("clean"), key, R.FUNCTION_PATTERNS[key]), F.lit(None).cast("string"))
    cut = clean.withColumn("marked", marked)
    found = F.greatest(X.occurrences(F.col("marked"), X.MARK), F.lit(0))
    # Staged, because the lines are read inside lambdas and must not be recomputed there.
    return staged(
        cut,
        files.columns,
        advisor=X.advisor_lines(text),
        starts=X.mark_lines(F.split("marked", "\n", -1)),
        pieces=F.slice(F.split("marked", X.MARK, -1), F.lit(2), found),
    )


def _measured(files: DataFrame, complexity: bool = True) -> DataFrame:
    """Add ``measured``: start, piece, length and, if wanted, complexity of every function match."""
    length = lambda f: F.when(
        F.col("extractor") == "Python", _indented_length(f["pieces"], f["starts"])
    ).otherwise(_braced_length(f["pieces"]))
    sized = _pieces(files).withColumn(
        "sized",
        F.transform(
            F.arrays_zip("starts", "pieces"),
            lambda f: F.struct(f["starts"].alias("line"), f["pieces"].alias("piece"), length(f).alias("length")),
        ),
    )
    if not complexity:
        return sized.withColumn("measured", F.transform("sized", lambda f: F.struct(f["line"], f["piece"], f["length"], F.lit(0).alias("complexity"))))
    body = lambda f: F.slice("advisor", f["line"], f["length"] + 1)
    measured = F.transform(
        "sized",
        lambda f: F.struct(
            f["line"].alias("line"),
            f["piece"].alias("piece"),
            f["length"].alias("length"),
            (F.regexp_count(F.array_join(body(f), "\n"), F.lit(R.FUNCTION_BRANCHES)) + 1).alias("complexity"),
        ),
    )
    return sized.withColumn("measured", measured)


def _described(functions: Column, counted: bool, parts: Sequence[str]) -> Column:
    """Name and nesting for measured functions, null unless among ``parts``; a tab counts as one column here."""
    depth = lambda line: F.when(X.strip(line) == "", 0).otherwise(F.floor(X.leading(line) / 4).cast("int"))
    nesting = lambda f: F.coalesce(F.array_max(F.transform(F.slice("advisor", f["line"], f["length"] + 1), depth)), F.lit(0))
    return F.transform(
        functions,
        lambda f: F.struct(
            (_function_name(f["piece"]) if "name" in parts else F.lit(None).cast("string")).alias("name"),
            f["line"].alias("line"),
            f["length"].alias("length"),
            (f["complexity"] if counted else F.lit(None).cast("int")).alias("complexity"),
            (nesting(f) if "nesting" in parts else F.lit(None).cast("int")).alias("nesting"),
        ),
    )


def with_functions(files: DataFrame, keep_all: bool = False, parts: Sequence[str] = PARTS) -> DataFrame:
    """Add ``functions``: hotspot functions by complexity, then position.

    Hotspots are longer than 30 lines or more complex than 10; ``keep_all`` keeps every match.
    Name and nesting are null unless among ``parts``; with ``keep_all`` so is complexity, and the
    functions then stand by position.
    """
    counted = not keep_all or "complexity" in parts
    measured = _measured(files, counted)
    hot = F.col("measured") if keep_all else F.filter(
        "measured", lambda f: (f["length"] > MIN_LENGTH) | (f["complexity"] > MIN_COMPLEXITY)
    )
    ranked = F.transform(
        F.array_sort(
            F.transform(
                _described(F.col("hot"), counted, parts),
                lambda f, i: F.struct((-f["complexity"] if counted else F.lit(0)).alias("order"), i.alias("pos"), f.alias("f")),
            )
        ),
        lambda x: x["f"],
    )
    known = F.coalesce(ranked, F.array().cast(FUNCTION_TYPE))
    return staged(measured.withColumn("hot", hot), files.columns, functions=known)


def function_rows(files: DataFrame, keep_all: bool = False, parts: Sequence[str] = PARTS) -> DataFrame:
    """``file_id, extractor, rank, name, line, length, complexity, nesting``; rank 1 is the most complex.  For ``parts`` see :func:`with_functions`."""
    found = with_functions(files.filter(F.col("extractor").isNotNull()).select("file_id", "text", "extractor"), keep_all, parts)
    rows = found.select("file_id", "extractor", F.posexplode("functions").alias("pos", "f"))
    return rows.select("file_id", "extractor", (F.col("pos") + 1).alias("rank"), "f.*")


def with_classes(files: DataFrame) -> DataFrame:
    """Add ``classes``: name and line of every class match; not staged, so plans that read no classes look for none."""
    text = F.coalesce("text", F.lit(""))
    nothing = F.lit(None)
    keys = list(R.CLASS_PATTERNS)
    marked = _per_extractor(lambda key: X.marked(text, R.CLASS_PATTERNS[key]), nothing.cast("string"), keys)
    names = _per_extractor(
        lambda key: F.regexp_extract_all(text, F.lit(R.CLASS_PATTERNS[key]), F.lit(R.CLASS_NAME_GROUPS.get(key, 1))),
        nothing.cast("array<string>"),
        keys,
    )
    located = files.withColumns({"class_marked": marked, "class_names": names})
    lines = X.mark_lines(F.split("class_marked", "\n", -1))
    zipped = F.zip_with("class_names", lines, lambda name, line: F.struct(name.alias("name"), line.alias("line")))
    known = F.coalesce(zipped, F.array().cast("array<struct<name:string,line:int>>"))
    return located.select(*files.columns, known.alias("classes"))


def class_rows(files: DataFrame) -> DataFrame:
    """``file_id, name, line`` per class."""
    found = with_classes(files.filter(F.col("extractor").isNotNull()).select("file_id", "text", "extractor"))
    return found.select("file_id", F.inline("classes"))
