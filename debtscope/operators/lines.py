"""Line classification: comment blocks, HTML script mode, comments, boilerplate and code.

Both carried states depend on nothing but the sequence of line classes of one file.  Each
line is therefore reduced to one letter, the letters of a file are joined to a short string,
and the states are read off that string with two regular expressions.  The whole step is
row-local: no line and no text ever crosses a shuffle, and the cost is linear in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from debtscope import dims
from debtscope.functions import regex as R, text as X

# Line classes: N no token, E block end only, I block opened and closed on the line,
# U block opened and left open, X left open with an end token elsewhere on the line.
_CLASSES = "NEIUX"
_SCRIPT_CLASSES = _CLASSES.lower()
#: HTML lines carry one class per token set: a letter for each pair (markup, script).
_PAIRS = "".join(chr(ord("0") + i) for i in range(len(_CLASSES) ** 2))
_MARKUP_OF_PAIR = "".join(c for c in _CLASSES for _ in _CLASSES)
_SCRIPT_OF_PAIR = "".join(c for _ in _CLASSES for c in _SCRIPT_CLASSES)

#: Script mode lasts from an opening tag line to the next closing tag line.
_SCRIPT_REGION = R.rx("S[^T]*+")
#: A comment block lasts from a line that leaves it open to the next line with an end token.
_COMMENT_BLOCK = R.rx("[UXux][^EIXeix]*+[EIXeix]?")

_MAX_STARTS = max(len(row[3]) for row in dims.LANGUAGES)
_MAX_ENDS = max(len(row[4]) for row in dims.LANGUAGES)
_MAX_SINGLES = max(len(row[2]) for row in dims.LANGUAGES)


def _any(tokens: Column, most: int, test) -> Column:
    found = F.lit(False)
    for i in range(most):
        found = found | F.coalesce(test(F.get(tokens, F.lit(i))), F.lit(False))
    return found


def _block_class(line: Column, starts: Column, ends: Column, most_starts=_MAX_STARTS, most_ends=_MAX_ENDS) -> Column:
    """One of :data:`_CLASSES`; the first start token in list order decides."""

    def opened(start: Column) -> Column:
        rest = F.substr(line, F.instr(line, start) + F.length(start))
        closed = _any(ends, most_ends, lambda end: F.contains(rest, end))
        return F.when(closed, "I").when(has_end, "X").otherwise("U")

    has_end = _any(ends, most_ends, lambda end: F.contains(line, end))
    result = None
    for i in range(most_starts):
        start = F.get(starts, F.lit(i))
        hit = F.contains(line, start)
        result = F.when(hit, opened(start)) if result is None else result.when(hit, opened(start))
    return result.otherwise(F.when(has_end, "E").otherwise("N"))


def _html_class(line: Column) -> Column:
    markup = _block_class(line, F.array(F.lit("<!--")), F.array(F.lit("-->")), 1, 1)
    script = _block_class(line, F.array(F.lit("/*")), F.array(F.lit("*/")), 1, 1)
    pair = F.translate(markup, _CLASSES, "01234").cast("int") * len(_CLASSES) + F.translate(
        script, _CLASSES, "01234"
    ).cast("int")
    letter = F.substr(F.lit(_PAIRS), pair + 1, F.lit(1))
    tagged = F.contains(line, F.lit("<"))
    return (
        F.when(tagged & F.rlike(line, F.lit(R.SCRIPT_OPEN)), "S")
        .when(tagged & F.rlike(line, F.lit(R.SCRIPT_CLOSE)), "T")
        .otherwise(letter)
    )


def _rewrite(text: Column, pattern: str, inside, outside) -> Column:
    """Apply ``inside`` to every match of ``pattern`` and ``outside`` to the text between."""
    gaps = F.transform(F.split(text, pattern, -1), outside)
    hits = F.array_append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), inside), F.lit(""))
    return F.array_join(F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, hit)), "")


def _script_modes(classes: Column) -> Column:
    """Resolve HTML pairs: lower-case script class inside script mode, markup class outside."""
    return _rewrite(
        classes,
        _SCRIPT_REGION,
        lambda region: F.translate(region, _PAIRS, _SCRIPT_OF_PAIR),
        lambda gap: F.translate(gap, _PAIRS, _MARKUP_OF_PAIR),
    )


def _comment_blocks(classes: Column) -> Column:
    """Rewrite blocks: opening line O, other lines C (script lines in lower case, tags kept)."""
    later = lambda block: F.translate(F.substr(block, F.lit(2)), "NEIUXneiux", "CCCCCccccc")
    opening = lambda block: F.translate(F.left(block, F.lit(1)), "UXux", "OOoo")
    blocks = _rewrite(classes, _COMMENT_BLOCK, lambda b: F.concat(opening(b), later(b)), lambda gap: gap)
    return F.when(F.rlike(classes, F.lit("[UXux]")), blocks).otherwise(classes)


def _kind(stripped: Column, state: Column, singles: Column) -> Column:
    """T tag, B blank, C comment, P lone bracket, K code; script lines of P and K in lower case."""
    in_script = state > "Z"
    single = F.when(in_script, F.startswith(stripped, F.lit("//"))).otherwise(
        _any(singles, _MAX_SINGLES, lambda token: F.startswith(stripped, token))
    )
    bracket = (F.length(stripped) == 1) & F.contains(F.lit("{}[]();,"), stripped)
    return (
        F.when(state.isin("S", "T"), "T")
        .when(stripped == "", "B")
        .when(state.isin("O", "C", "I", "o", "c", "i"), "C")
        .when(single, "C")
        .when(in_script, F.when(bracket, "p").otherwise("k"))
        .otherwise(F.when(bracket, "P").otherwise("K"))
    )


def with_line_arrays(files: DataFrame) -> DataFrame:
    """Add ``lines``, ``stripped``, ``states`` and ``kinds``: parallel arrays, one entry per line."""
    html = F.col("lang") == "HTML"
    starts, ends = F.col("block_start"), F.col("block_end")
    plain = F.array_join(F.transform("lines", lambda line: _block_class(line, starts, ends)), "")
    pairs = F.array_join(F.transform("lines", _html_class), "")
    kinds = F.zip_with("stripped", "states", lambda s, state: _kind(s, state, F.col("single")))
    return (
        files.withColumn("lines", X.metric_lines(F.coalesce("text", F.lit(""))))
        .withColumn("line_classes", F.when(html, pairs).otherwise(plain))
        .withColumn("line_classes", F.when(html, _script_modes(F.col("line_classes"))).otherwise(F.col("line_classes")))
        .withColumns(
            {
                "states": F.split(_comment_blocks(F.col("line_classes")), "", -1),
                "stripped": F.transform("lines", X.strip),
            }
        )
        .withColumn("states", F.when(F.size("lines") > 0, F.col("states")).otherwise(F.array().cast("array<string>")))
        .withColumn("kinds", kinds)
        .drop("line_classes")
    )


def line_rows(files: DataFrame) -> DataFrame:
    """The line relation: one row per metric line with its states and class.

    ``tag`` names script tags, ``in_comment`` is the state before the line, ``opens`` marks the
    line of a block start, ``kind`` is T, B, C, P or K, and ``is_logic_line`` flags code and
    lone brackets of a logic language or of an HTML script.
    """
    zipped = with_line_arrays(files).select(
        "file_id",
        "lang",
        "is_logic",
        F.posexplode(F.arrays_zip("lines", "stripped", "states", "kinds")).alias("pos", "x"),
    )
    state, kind = F.col("x.states"), F.col("x.kinds")
    return zipped.select(
        "file_id",
        "lang",
        (F.col("pos") + 1).alias("n"),
        F.col("x.lines").alias("line"),
        F.col("x.stripped").alias("stripped"),
        F.when(state == "S", "start").when(state == "T", "end").alias("tag"),
        (state > "Z").alias("in_script"),
        state.isin("C", "c").alias("in_comment"),
        state.isin("O", "o", "I", "i").alias("opens"),
        F.upper(kind).alias("kind"),
        ((kind > "Z") | (F.col("is_logic") & kind.isin("P", "K"))).alias("is_logic_line"),
    )
