"""Least gap between kept rows of a key, chosen greedily from the first.

Whether a row is kept depends on the row kept before it, so the choice runs through a key
from its first row on. Here it is taken by jump pointers, all as equi-joins:

1. links: each time's successor is the first time of the key at least a gap later, found
   in buckets of time (``adjacent``);
2. up: from the successors the ``FAN``-fold ones, from these the ``FAN * FAN``-fold ones,
   and so on, until no first row has one. A level keeps only times that are the first of
   their key or a successor on the level below; choices that start apart soon meet, so the
   levels get smaller fast;
3. down: the kept times of a level are those of the level above and the hops in between.

No step gathers the rows of a key, however many it has: a join meets single times of a key,
and a bucket of the first step holds what happens in its minutes. The number of levels is
the logarithm of the longest choice. Levels are written below the shared folder when the
DataFrame is built; going down is one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from opslens.operators import adjacent
from opslens.session import scratch

_MICRO = 1_000_000
FAN = 4
MINUTES = 300


def _links(times: DataFrame, gap: int, width: int) -> DataFrame:
    """(id, to, first) of each time: the first time of its key at least ``gap`` later, null if there is none.

    Time runs backwards here, so that the first later time is the latest earlier one.
    """
    asking = times.select("_key", "_id", (1 - F.col("_at") - gap).alias("_turned"))
    there = times.select("_key", (-F.col("_at")).alias("_turned"))
    found = adjacent.as_of_previous(asking, there, ["_key"], "_turned", F.floor(F.col("_turned") / width))
    onward = times.select("_key", (-F.col("_at")).alias("prev__turned"), F.col("_id").alias("to"))
    firsts = times.groupBy("_key").agg(F.min_by("_id", "_at").alias("_id")).select("_id", F.lit(True).alias("first"))
    found = found.join(onward, ["_key", "prev__turned"], "left").join(firsts, "_id", "left")
    return found.select(F.col("_id").alias("id"), "to", F.coalesce("first", F.lit(False)).alias("first"))


def _hops(links: DataFrame) -> DataFrame:
    """(id, first, hops): the next ``FAN`` times of each time that is a first one or follows another, null where they end."""
    step = links.filter("to is not null")
    follows = step.select(F.col("to").alias("id")).distinct().withColumn("follows", F.lit(True))
    found = links.join(follows, "id", "left").filter("first or follows").select("id", "first", F.col("to").alias("hop1"))
    for i in range(1, FAN):
        onward = step.select(F.col("id").alias(f"hop{i}"), F.col("to").alias(f"hop{i + 1}"))
        found = found.join(onward, f"hop{i}", "left")
    return found.select("id", "first", F.array(*[F.col(f"hop{i + 1}") for i in range(FAN)]).alias("hops"))


def _levels(links: DataFrame) -> list[DataFrame]:
    """Hops over 1, FAN, FAN * FAN, ... successors each, up to the level where no first row goes further."""
    levels = []
    while True:
        going, last = Observation(), F.element_at("hops", FAN)
        level = scratch(_hops(links).observe(going, F.count(F.when(F.col("first") & last.isNotNull(), 1)).alias("n")), "gap-level")
        levels.append(level)
        if not going.get["n"]:
            return levels
        links = level.select("id", last.alias("to"), "first")


def keep_gap(df: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: int, width_seconds: int | None = None) -> DataFrame:
    """Rows of each key at least ``gap_seconds`` after the row kept before them.

    ``tie`` (a number) orders rows of equal time and, with the keys and the time, names a
    row. Only the first row of a time can be kept, so the times are made distinct first; a
    row without a time is not kept. Successors are looked up in buckets of ``width_seconds``,
    five minutes by default and never less than the gap.
    """
    if gap_seconds <= 0:
        raise ValueError("the gap must be positive")
    micros: Column = F.unix_micros(F.col(ts).cast("timestamp"))
    named = df.withColumn("_key", F.to_json(F.struct(*keys))).withColumn("_at", micros).withColumn("_tie", F.col(tie).cast("long"))
    times = named.filter("_at is not null").groupBy("_key", "_at").agg(F.min("_tie").alias("_tie"))
    times = scratch(times.withColumn("_id", F.monotonically_increasing_id()), "gap-times")  # numbered once, when written
    links = scratch(_links(times, gap_seconds * _MICRO, max(width_seconds or MINUTES, gap_seconds) * _MICRO), "gap-links")
    levels = _levels(links)
    kept = levels[-1].filter("first").select("id")
    for level in reversed(levels):
        hops = kept.join(level, "id").select(F.explode(F.concat(F.array("id"), F.slice("hops", 1, FAN - 1))).alias("id"))
        kept = hops.filter("id is not null")
    rows = times.join(kept, F.col("_id") == F.col("id"), "left_semi")
    return named.join(rows, ["_key", "_at", "_tie"], "left_semi").drop("_key", "_at", "_tie")
