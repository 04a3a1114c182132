"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from debtscope.llm.common import saved


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Add ``place`` (from 0) of each row in its group by ``order``, and ``size`` of the group.

    Rows are dealt by ranges of group and order, so a group of any size is cut over many tasks;
    equal rows are spread by a random last key, and which of them comes first is not defined.
    Places in a task follow from its sorted rows, and one number per task and group is added to
    put the tasks in line.  ``group`` columns must not be null; without any, all rows are one group.
    """
    keys = [*[F.col(c) for c in group], *order, F.col("__spread")]
    dealt = rows.withColumn("__spread", F.rand(11)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = saved(dealt.withColumn("__at", F.monotonically_increasing_id()).drop("__spread"))
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33))
    runs = dealt.groupBy("__part", *group).agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    before = F.sum("n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("__part", *group, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__shift"), F.sum("n").over(whole).alias("size"))
    joined = dealt.join(runs, ["__part", *group])
    return joined.withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")
