"""Name/value rows to columns and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def property_bag(df: DataFrame, keys: list[str], name: str, value: str,
                 wanted: dict[str, str]) -> DataFrame:
    """One row per key with a column per wanted property (last one by value wins)."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(name) == prop, F.col(value))).alias(column)
        for column, prop in wanted.items()
    ])


def to_property_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns to ``(name, value)`` rows; the inverse of :func:`property_bag`."""
    return df.select(*keys, *[F.col(c).cast("string") for c in columns]).unpivot(
        keys, columns, "name", "value").filter(F.col("value").isNotNull())
