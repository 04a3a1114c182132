"""Line counts of files that are too large for one row, from segments of their lines.

A file is a table of segments (``file_id, part, text``), each ending at a line end.  What a
segment does to the two carried states, script mode and comment block, is a function of the
state it is entered in: for each of the four combinations the one it is left in.  Such functions
are composed in order, which needs a few numbers per segment; then every segment is classified
from the state it is entered in, and its counts are summed.  Texts are scanned once, each segment
on its own, and reduced to two letters for each line; only those are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from debtscope.functions import text as X
from debtscope.functions.stage import staged
from debtscope.operators import lines as L

#: Letters in front of a segment's classes that stand for the state it is entered in: outside of
#: everything, in a comment block, in script mode, in a comment block within script mode.
ENTRIES = ("", "U", "S", "Su")
#: Characters of a segment that :func:`cut` makes.
SIZE = 1 << 22


def cut(files: DataFrame, size: int = SIZE) -> DataFrame:
    """Segments ``part, text`` of a text column, cut behind the first line end from ``size`` characters on; other columns are kept.

    An empty or null text is one segment.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{{size},}}?\n|.+"), F.lit(0))
    pieces = F.when(text == "", F.array(F.lit(""))).otherwise(pieces)
    kept = [c for c in files.columns if c != "text"]
    return files.select(*kept, F.posexplode(pieces).alias("part", "text"))


#: A letter for each combination of what a line shows by itself: blank, comment of the language, comment of a script, lone bracket.
_MARKS = "ABCDEFGHIJKLMNOP"


def _marked(mark: Column, bit: int) -> Column:
    return F.contains(F.lit("".join(letter for i, letter in enumerate(_MARKS) if i & bit)), mark)


def facts(segments: DataFrame) -> DataFrame:
    """``file_id, part, html, is_logic, classes, marks``: two letters for each line of a segment.

    ``segments`` has ``file_id, part, text`` and the language columns.
    """
    html = F.col("lang") == "HTML"
    starts, ends = F.col("block_start"), F.col("block_end")

    def mark(line: Column) -> Column:
        stripped = X.strip(line)
        single = L._any(F.col("single"), L._MAX_SINGLES, lambda token: F.startswith(stripped, token))
        bracket = (F.length(stripped) == 1) & F.contains(F.lit("{}[]();,"), stripped)
        bits = [stripped == "", single, F.startswith(stripped, F.lit("//")), bracket]
        number = sum((bit.cast("int") * (1 << i) for i, bit in enumerate(bits)), F.lit(1))
        return F.substr(F.lit(_MARKS), number, F.lit(1))

    plain = F.array_join(F.transform("lines", lambda line: L._block_class(line, starts, ends)), "")
    pairs = F.array_join(F.transform("lines", L._html_class), "")
    lined = segments.withColumn("lines", X.metric_lines(F.coalesce("text", F.lit(""))))
    columns = {"html": html, "classes": F.when(html, pairs).otherwise(plain), "marks": F.array_join(F.transform("lines", mark), "")}
    return staged(lined, ["file_id", "part", "is_logic"], **columns)


def _resolved(entry: Column) -> Column:
    """The classes behind their entry letters, with the script mode of each line decided."""
    classes = F.concat(entry, "classes")
    return F.when(F.col("html"), L._script_modes(classes)).otherwise(classes)


def _left_in(entry: str) -> Column:
    """Which of :data:`ENTRIES` holds behind a segment that is entered in one of them."""
    classes = _resolved(F.lit(entry))
    script = F.rlike(classes, F.lit("S[^T]*$")) & F.col("html")
    open_ = F.rlike(F.regexp_replace(classes, F.lit("[UXux][^EIXeix]*+[EIXeix]"), F.lit("")), F.lit("[UXux]"))
    return script.cast("int") * 2 + open_.cast("int")


def transitions(reduced: DataFrame) -> DataFrame:
    """``file_id, part, leaves``: for each entry state the state behind the segment, from its :func:`facts`."""
    return reduced.select("file_id", "part", F.array(*[_left_in(entry) for entry in ENTRIES]).alias("leaves"))


def entered(steps: DataFrame) -> DataFrame:
    """``file_id, part, state``: the state each segment is entered in, from the composed functions of the ones before it.

    The functions of one file meet in a task: four small numbers for each segment.
    """
    listed = F.array_sort(F.collect_list(F.struct("part", "leaves")))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<part:int,state:int>>").alias("seen"))

    def step(acc: Column, segment: Column) -> Column:
        here = F.struct(segment["part"].alias("part"), acc["state"].alias("state"))
        return F.struct(F.get(segment["leaves"], acc["state"]).alias("state"), F.array_append(acc["seen"], here).alias("seen"))

    grouped = steps.groupBy("file_id").agg(listed.alias("listed"))
    return grouped.select("file_id", F.inline(F.aggregate("listed", start, step, lambda acc: acc["seen"])))


def _kind(state: Column, mark: Column) -> Column:
    """As ``operators.lines`` names kinds: T tag, B blank, C comment, P lone bracket, K code, the last two in lower case within scripts."""
    in_script = state > "Z"
    single = F.when(in_script, _marked(mark, 4)).otherwise(_marked(mark, 2))
    bracket = _marked(mark, 8)
    return (
        F.when(state.isin("S", "T"), "T")
        .when(_marked(mark, 1), "B")
        .when(state.isin("O", "C", "I", "o", "c", "i") | single, "C")
        .when(in_script, F.when(bracket, "p").otherwise("k"))
        .otherwise(F.when(bracket, "P").otherwise("K"))
    )


def classified(reduced: DataFrame) -> DataFrame:
    """``file_id, part, is_logic, kinds``: the kinds of a segment's lines, a letter each, from :func:`facts`."""
    entry = F.get(F.array(*map(F.lit, ENTRIES)), F.col("state"))
    known = reduced.join(entered(transitions(reduced)), ["file_id", "part"]).withColumn("entry", entry)
    states = F.substr(L._comment_blocks(_resolved(F.col("entry"))), F.length("entry") + 1)
    kinds = F.zip_with(F.split(states, ""), F.split("marks", ""), _kind)
    return known.select("file_id", "part", "is_logic", F.when(F.col("marks") == "", "").otherwise(F.array_join(kinds, "")).alias("kinds"))


def line_counts(segments: DataFrame, folder: str) -> DataFrame:
    """``file_id, total, code, comments, boilerplate, logic_lines`` of files given as segments (see :func:`facts`).

    The reduced segments are written to ``folder``, which all executors share, so texts are scanned once.
    """
    facts(segments).write.mode("overwrite").parquet(folder)
    kinds = F.col("kinds")

    def of(letters: str) -> Column:
        return F.length(F.regexp_replace(kinds, F.lit(f"[^{letters}]"), F.lit("")))

    counted = classified(segments.sparkSession.read.parquet(folder)).select(
        "file_id",
        F.length(kinds).alias("total"),
        of("Kk").alias("code"),
        of("C").alias("comments"),
        of("TBPp").alias("boilerplate"),
        F.when(F.col("is_logic"), of("KPkp")).otherwise(of("kp")).alias("logic_lines"),
    )
    return counted.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]])
