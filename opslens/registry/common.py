"""Shared parts of the query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from opslens.bindings import Ops

# Fixed report times, inside the range of the driver's data.
BACKUP_AS_OF = "2001-08-01 12:00:00"
AS_OF = "2024-01-31 00:00:00"


@dataclass(frozen=True)
class Query:
    """A report over bound tables and the same question for DuckDB (if SQL can ask it)."""

    run: Callable[[Ops], DataFrame]
    sql: str | None = None


def plain(df: DataFrame) -> DataFrame:
    """Result columns in types both engines print alike."""
    def shown(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            return F.round(c.cast("double"), 6).alias(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("long").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return c.cast("string").alias(field.name)
        if isinstance(field.dataType, T.BinaryType):
            return F.concat(F.lit("0x"), F.hex(c)).alias(field.name)
        return c
    return df.select(*[shown(f) for f in df.schema.fields])
