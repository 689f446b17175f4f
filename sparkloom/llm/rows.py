"""Rows that pass through an operator, out of reach of the operator's own names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import ship

ROW = "_row"


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and the whole row as one struct beside them."""
    ship(df.sparkSession)
    return df.select(*needed, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def passengers(df: DataFrame, own: tuple[str, ...] = ()) -> list[Column]:
    """The packed columns of ``df`` but those whose name the operator gives out itself."""
    taken = {c.lower() for c in own}
    return [F.col(ROW)[c].alias(c) for c in df.schema[ROW].dataType.names if c.lower() not in taken]
