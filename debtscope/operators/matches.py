"""All matches of a pattern with their line numbers.

``match_rows`` marks every match start inside the text and reads the line numbers off the
marked lines, so a file costs one scan and no window over its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from debtscope.functions import text as X


def match_lines(text: Column, pattern: str) -> Column:
    """Line numbers of all matches, ascending, one entry per match."""
    return X.mark_lines(F.split(X.marked(text, pattern), "\n", -1))


def match_rows(files: DataFrame, pattern: str, **groups: int) -> DataFrame:
    """``file_id, pos, line, match`` per match; ``groups`` adds capture groups by name."""
    text = F.col("text")
    parts = [match_lines(text, pattern).alias("line"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")]
    parts += [F.regexp_extract_all(text, F.lit(pattern), F.lit(no)).alias(name) for name, no in groups.items()]
    zipped = files.filter(F.rlike(text, F.lit(pattern))).select("file_id", *parts)
    names = ["line", "match", *groups]
    return zipped.select("file_id", F.posexplode(F.arrays_zip(*names)).alias("pos", "x")).select(
        "file_id", "pos", *[F.col(f"x.{name}").alias(name) for name in names]
    )


def first_mark_lines(marked: Column, marks: Column, most: int) -> Column:
    """Line numbers of the first ``most`` of the ``marks`` in a text, so the pattern itself is run only once."""
    pieces = F.slice(F.split(marked, X.MARK, most + 1), F.lit(1), F.least(F.lit(most), marks))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("lines"))

    def step(acc: Column, newlines: Column) -> Column:
        at = acc["at"] + newlines
        return F.struct(at.alias("at"), F.array_append(acc["lines"], at).alias("lines"))

    return F.aggregate(F.transform(pieces, lambda piece: X.occurrences(piece, "\n")), start, step, lambda acc: acc["lines"])
