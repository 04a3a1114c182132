"""Columns that are evaluated exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def staged(files: DataFrame, keep: list[str], **computed: Column) -> DataFrame:
    """Add columns that are evaluated exactly once.

    A filter over a projected column is pushed below the projection together with its
    expression, which would run an expensive expression twice.  Emitting the columns from a
    one-row generator keeps such filters above it.
    """
    row = F.struct(*[value.alias(name) for name, value in computed.items()])
    return files.select(*keep, F.inline(F.array(row)))
