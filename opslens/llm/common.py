"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from opslens.session import new_folder

#: The white space that separates words, and the capital letters that are folded.
SPACES = " \t\n\x0b\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table below the shared folder and reads it again: a cut lineage that outlives executors."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z folded, every other character as it is."""
    return F.translate(text, CAPITALS, CAPITALS.lower())


def spaced_words(text: Column) -> Column:
    """Words between white space as an array; a null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def bounded_batches(spark, rows: int = 2000, size: str = "32m") -> None:
    """Bounds the Arrow batches of Python tasks by rows and bytes, so that long texts cannot pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker makes once and keeps for all its tasks."""
    store = sys.modules.setdefault("_opslens_kept", types.ModuleType("_opslens_kept")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]
