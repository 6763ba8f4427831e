"""Changes to our own tables, as new DataFrames; nothing is edited in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def update_from(df: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns taken from the matching source row, kept where there is none."""
    right = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns],
                          F.lit(True).alias("_hit"))
    joined = df.join(right, keys, "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return joined.select(*df.columns)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or unknown."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def delete_matching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a match; the other side is reduced to its keys before it is shuffled."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def archive_split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows to archive; together they are the input."""
    moved = F.coalesce(condition, F.lit(False))
    return df.filter(~moved), df.filter(moved)


def archive(df: DataFrame, condition: Column, archive_path: str, keep_path: str, batch: str) -> None:
    """Move matching rows to an archive folder and write the rest beside it.

    The archive is partitioned by batch and a batch overwrites only itself, so
    running it again after a failure gives the same tables.
    """
    kept, moved = archive_split(df, condition)
    moved.write.mode("overwrite").parquet(f"{archive_path}/archive_batch={batch}")
    kept.write.mode("overwrite").parquet(f"{keep_path}/after_batch={batch}")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of several selects gathered into one table, by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_present(parts: dict[str, DataFrame | None]) -> DataFrame:
    """Union of the branches whose source was captured at all."""
    return union_all([df for df in parts.values() if df is not None])
