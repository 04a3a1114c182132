"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from debtscope.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """Smallest key reachable from each key of ``edges`` (``a``, ``b``), as (``k``, ``comp``).

    Every round takes the smallest label among the neighbours and then jumps to that label's own
    label, so long chains shrink by powers.  Sums per key combine before they are shuffled, and
    each round is written, so lost executors repeat one round at most.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("k")).agg(F.least(F.col("k"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.min("comp").alias("near"))
        moved = labels.join(near, "k").select("k", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("k").alias("new"), F.col("comp").alias("far"))
        moved = saved(moved.join(jump, "new").select("k", "comp", F.least("new", "far").alias("new")))
        changed = not moved.filter(F.col("new") != F.col("comp")).isEmpty()
        labels = moved.select("k", F.col("new").alias("comp"))
        if not changed:
            return labels
