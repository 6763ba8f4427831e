"""Greatest rows per key and top rows overall.

``rank() <= n`` is planned with a group limit before the shuffle: each map task
sends at most ``n`` ranks of a key, so hot keys stay small on the wire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_rows(df: DataFrame, keys: list[str], order: list[Column], ties: bool = False) -> DataFrame:
    """First row per key in ``order``; with ``ties`` all rows equal to the first."""
    return top_per_group(df, keys, order, 1, ties)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  ties: bool = False) -> DataFrame:
    number = F.rank() if ties else F.row_number()
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", number.over(window)).filter(F.col("_rank") <= n).drop("_rank")


def top_rows(df: DataFrame, by: str, tie_break: list[str], n: int) -> DataFrame:
    """Top ``n`` by a measure with a total order, without a full sort."""
    return df.orderBy(F.desc(by), *tie_break).limit(n)
