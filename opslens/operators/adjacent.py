"""Neighbouring rows of a key, in time or line order.

A plain ``lag`` puts all rows of a key into one task. Here a key is cut into
buckets (some minutes of time, a run of lines): rows look at their neighbour
inside the bucket, and the first row of a bucket takes the last row of the
nearest earlier bucket. Only one row per key and bucket crosses buckets.

Both steps stay bounded however much one key holds: a bucket by what happens in
its minutes, the second step by the number of buckets in the time covered
(with five minutes about a million in ten years).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslens.functions import dates

_BUCKET = "_bucket"


def time_bucket(ts: str, seconds: int = 300) -> Column:
    return F.floor(dates.epoch_seconds(F.col(ts)) / seconds)


def line_bucket(line: str, lines: int = 10000) -> Column:
    return F.floor(F.col(line) / lines)


def _seeded(rows: DataFrame, keys: list[str], carried: DataFrame, value: str) -> DataFrame:
    """Rows with, per bucket, one leading row that brings the value from earlier buckets.

    A union instead of a join: the data is shuffled once, by key and bucket,
    and null keys need no special care.
    """
    seeds = (carried.filter(F.col("_carried").isNotNull())
             .select(*keys, _BUCKET, F.col("_carried").alias(value), F.lit(False).alias("_real")))
    return rows.withColumn("_real", F.lit(True)).unionByName(seeds, allowMissingColumns=True)


def _neighbour(df: DataFrame, keys: list[str], order: list[str], carry: list[str],
               bucket: Column, forward: bool, prefix: str) -> DataFrame:
    rows = df.withColumn(_BUCKET, bucket).withColumn("_packed", F.struct(*carry))
    position = F.struct(*order)
    edge = F.min_by("_packed", position) if forward else F.max_by("_packed", position)
    edges = rows.groupBy(*keys, _BUCKET).agg(edge.alias("_edge"))
    by_bucket = F.col(_BUCKET).desc() if forward else F.col(_BUCKET).asc()
    carried = edges.select(*keys, _BUCKET, F.lag("_edge").over(
        Window.partitionBy(*keys).orderBy(by_bucket)).alias("_carried"))
    sort = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
    inside = Window.partitionBy(*keys, _BUCKET).orderBy("_real", *sort)
    near = F.lag("_packed").over(inside)
    found = _seeded(rows, keys, carried, "_packed").withColumn("_near", near).filter("_real")
    return found.select(*df.columns, *[F.col("_near")[c].alias(f"{prefix}{c}") for c in carry])


def with_previous(df: DataFrame, keys: list[str], order: list[str], carry: list[str],
                  bucket: Column) -> DataFrame:
    """Adds ``prev_<column>`` of the row just before, per key; order must be total."""
    return _neighbour(df, keys, order, carry, bucket, forward=False, prefix="prev_")


def with_next(df: DataFrame, keys: list[str], order: list[str], carry: list[str],
              bucket: Column) -> DataFrame:
    """Adds ``next_<column>`` of the row just after, per key."""
    return _neighbour(df, keys, order, carry, bucket, forward=True, prefix="next_")


def with_earlier_time(df: DataFrame, keys: list[str], ts: str, bucket: Column) -> DataFrame:
    """Adds ``prev_<ts>``, the latest time of the key strictly before each row's.

    Rows of one time get the same answer, so no order among them is needed, and
    the times carried between buckets are plain maxima.
    """
    rows = df.withColumn(_BUCKET, bucket)
    edges = rows.groupBy(*keys, _BUCKET).agg(F.max(ts).alias("_edge"))
    carried = edges.select(*keys, _BUCKET, F.lag("_edge").over(
        Window.partitionBy(*keys).orderBy(_BUCKET)).alias("_carried"))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    earlier = (Window.partitionBy(*keys, _BUCKET).orderBy(micros)
               .rangeBetween(Window.unboundedPreceding, -1))
    found = _seeded(rows, keys, carried, ts).withColumn(f"prev_{ts}", F.max(ts).over(earlier))
    return found.filter("_real").select(*df.columns, f"prev_{ts}")


def carry_forward(df: DataFrame, keys: list[str], order: str, value: Column, bucket: Column,
                  name: str) -> DataFrame:
    """Adds the latest non-null ``value`` at or before each row, per key."""
    rows = df.withColumn(_BUCKET, bucket).withColumn("_value", value)
    newest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order)))
    edges = rows.groupBy(*keys, _BUCKET).agg(newest.alias("_edge"))
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*keys, _BUCKET, F.last("_edge", ignorenulls=True).over(before).alias("_carried"))
    upto = (Window.partitionBy(*keys, _BUCKET).orderBy("_real", order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = _seeded(rows, keys, carried, "_value").withColumn(name, F.last("_value", ignorenulls=True).over(upto))
    return found.filter("_real").select(*df.columns, name)


def as_of_previous(left: DataFrame, right: DataFrame, keys: list[str], ts: str,
                   bucket: Column) -> DataFrame:
    """For each left row the latest right time strictly before it, as ``prev_<ts>``.

    One pass over the union of both sides instead of a correlated subquery.
    Among rows of one time the left ones come first, so they see earlier right
    rows only.
    """
    rows = (left.withColumn("_is_right", F.lit(False))
            .unionByName(right.select(*keys, ts).withColumn("_is_right", F.lit(True)), allowMissingColumns=True)
            .withColumn(_BUCKET, bucket).withColumn("_value", F.when(F.col("_is_right"), F.col(ts))))
    edges = rows.groupBy(*keys, _BUCKET).agg(F.max("_value").alias("_edge"))
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*keys, _BUCKET, F.max("_edge").over(before).alias("_carried"))
    upto = (Window.partitionBy(*keys, _BUCKET).orderBy("_real", ts, "_is_right")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = _seeded(rows, keys, carried, "_value").withColumn(f"prev_{ts}", F.max("_value").over(upto))
    return found.filter("_real and not _is_right").select(*left.columns, f"prev_{ts}")
