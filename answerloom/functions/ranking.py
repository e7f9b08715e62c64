"""Scores that compare equal across engines, and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round6(value: Column) -> Column:
    """Six decimals, half up; sums of doubles differ in the last bits with their order."""
    return F.floor(value * 1e6 + 0.5) / F.lit(1e6)


def ln_ratio(top: Column, bottom: Column) -> Column:
    return F.log(top.cast("double") / bottom.cast("double"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows of each group.

    The filter on row_number lets Spark cut each group to k rows inside every map task
    (WindowGroupLimit), so a group that holds a third of the rows still shuffles k rows per task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
