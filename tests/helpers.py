"""Small helpers for literal tables."""

from __future__ import annotations

from datetime import datetime


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df, *columns):
    """Rows as sorted tuples, of some columns or all."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def plan_of(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)
