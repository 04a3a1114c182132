"""Small text expressions shared by the operators; all of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from debtscope.functions.regex import SPACE_CHARS

#: Noncharacter used to mark match starts inside a text; no pattern matches on it.
MARK = "\ufdd0"
_MARK_STAND_IN = "\ufdd1"


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def leading(text: Column) -> Column:
    """Number of leading white-space characters."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(SPACE_CHARS)))


def occurrences(text: Column, piece: str) -> Column:
    """How often a one-character ``piece`` occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def unix_newlines(text: Column) -> Column:
    """Turn CRLF and lone CR into LF."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n"))).otherwise(text)


def metric_lines(text: Column) -> Column:
    """Lines as a text reader yields them: a final newline opens no further line."""
    body = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def advisor_lines(text: Column) -> Column:
    """Lines between newlines: a final newline is followed by an empty line."""
    return F.split(text, "\n", -1)


def indent_level(line: Column) -> Column:
    """Indent width in units of four columns, tabs advancing to the next multiple of four."""
    width = leading(line)
    tabbed = F.regexp_count(F.left(line, width), F.lit(r"[^\t]{4}|[^\t]{0,3}\t"))
    return F.when(F.contains(line, F.lit("\t")), tabbed).otherwise(F.floor(width / 4).cast("int"))


def unmarked(text: Column) -> Column:
    """A text in which :data:`MARK` stands for nothing; few texts hold it, so the others are not gone through letter by letter."""
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, _MARK_STAND_IN)).otherwise(text)


def put_marks(text: Column, pattern: str) -> Column:
    """Put :data:`MARK` in front of every match of ``pattern`` in a text that holds none."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(MARK + "$0"))


def marked(text: Column, pattern: str) -> Column:
    """Put :data:`MARK` in front of every match of ``pattern``."""
    return put_marks(unmarked(text), pattern)


def mark_lines(lines: Column) -> Column:
    """1-based line numbers of the marks, ascending, one entry per mark."""
    hits = lambda line: F.when(F.contains(line, F.lit(MARK)), occurrences(line, MARK)).otherwise(0)
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("n"), hits(line).alias("hits")))
    return F.flatten(
        F.transform(F.filter(numbered, lambda x: x["hits"] > 0), lambda x: F.array_repeat(x["n"], x["hits"]))
    )


def one_decimal(value: Column) -> Column:
    """Format with one decimal, ties to even on the exact double, without grouping commas."""
    return F.replace(F.format_number(value, 1), F.lit(","), F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
