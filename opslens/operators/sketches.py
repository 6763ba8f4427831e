"""Distinct counts over any span of days, from sketches kept per day.

A distinct count cannot be added up over days, but a sketch of a day's values can be merged
with those of other days: old captures are read once, and a count over weeks reads some
kilobytes per day and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: 2^14 registers: a relative standard error of about 0.8 %.
BITS = 14


def daily(df: DataFrame, keys: list[str], day: Column, values: list[str], bits: int = BITS) -> DataFrame:
    """One row per key and day with a sketch ``<value>_sketch`` of each column of values."""
    return df.groupBy(*keys, day.alias("day")).agg(*[F.hll_sketch_agg(v, bits).alias(f"{v}_sketch") for v in values])


def distinct_over(sketches: DataFrame, keys: list[str], values: list[str], span: Column | None = None) -> DataFrame:
    """Distinct values per key over all days, or per ``span`` of days, estimated from merged sketches."""
    groups = [*keys, *([span.alias("span")] if span is not None else [])]
    return sketches.groupBy(*groups).agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"{v}_sketch")).alias(f"distinct_{v}") for v in values])


def error(bits: int = BITS, sigmas: float = 3) -> float:
    """The relative error that an estimate exceeds in about one of 370 cases (at three sigmas)."""
    return sigmas * 1.04 / 2 ** (bits / 2)
