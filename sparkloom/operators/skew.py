"""Joins whose frequent keys do not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more rows than this, and than one in so many of all rows, is hot; so there are fewer hot keys than the second number.
HOT_ROWS, MOST_HOT = 256, 100_000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows.join(keyed, keys)``, where ``keyed(*keys, ..., n)`` knows the number ``n`` of each key's rows.

    ``total`` is the number of all rows, so fewer than ``MOST_HOT`` keys are
    hot.  They go to all tasks, and their rows stay where they are.
    """
    bound = max(HOT_ROWS, total // MOST_HOT)
    held = [c for c in keyed.columns if c not in keys]
    hot = keyed.where(F.col("n") > bound).select(*keys, F.struct(*held).alias("_hot"))
    flagged = rows.join(F.broadcast(hot), keys, "left")  # under MOST_HOT rows, as their counts add up to the total
    cold = flagged.where("_hot is null").drop("_hot").join(keyed.where(F.col("n") <= bound), keys)
    kept = [c for c in rows.columns if c not in keys]
    found = flagged.where("_hot is not null").select(*keys, *kept, *[F.col("_hot")[c].alias(c) for c in held])
    return cold.select(*keys, *kept, *held).union(found)
