"""Columns that an operator does not read, carried beside those it does, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carry(docs: DataFrame, *read: str) -> DataFrame:
    """The columns ``read`` and all others in one column ``row``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in read]
    return docs.select(*read, (F.struct(*rest) if rest else F.lit(0)).alias("row"))


def put_back(columns: list[str], *read: str) -> list[Column]:
    """Expressions over a frame of ``carry`` that give the columns of its documents in their order."""
    return [F.col(c) if c in read else F.col("row").getField(c).alias(c) for c in columns]
