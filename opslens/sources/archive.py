"""Moving rows of a table to its archive, in two phases with one manifest.

A table that is archived from is kept in generations. A move writes the rows that go and
the rows that stay as new folders nobody reads yet, and then publishes both with a single
entry in the table's ledger. Until that entry is there the table and its archive are what
they were; from then on they are what the move made of them. So a crash at any point
neither loses a row nor shows one twice, and the same move may simply be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from opslens.operators import changes
from opslens.sources.sinks import append_log, read_ledger, read_log


def _facts(generation: int, moved: int) -> dict[str, Column]:
    """What the ledger keeps of a generation, as aggregates that hold for no rows too."""
    same = lambda v: F.coalesce(F.max(F.lit(v).cast("long")), F.lit(v).cast("long"))
    return {"generation": same(generation), "moved": same(moved)}


def create(df: DataFrame, path: str) -> bool:
    """The first generation of a table at ``path``."""
    return append_log(df, path, "start", _facts(0, 0))


def _newest(spark: SparkSession, path: str):
    return read_ledger(spark, path).orderBy(F.desc("generation")).first()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest published generation."""
    newest = _newest(spark, path)
    return read_log(spark, path).filter(F.col("batch") == str(newest["batch"])).drop("batch")


def archived(spark: SparkSession, path: str, archive_path: str) -> DataFrame:
    """All rows whose move is published, with their ``batch``."""
    published = read_ledger(spark, path).filter("moved > 0").select(F.col("batch").cast("string"))
    if not published.head(1):  # nothing was moved yet
        return current(spark, path).limit(0).withColumn("batch", F.lit(""))
    return spark.read.parquet(f"{archive_path}/rows").withColumn("batch", F.col("batch").cast("string")).join(published, "batch", "left_semi")


def write_moved(moved: DataFrame, archive_path: str, batch: str) -> int:
    """The first phase: the rows that go, in a folder of their own that a second try overwrites; returns how many."""
    seen = Observation()
    moved.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{archive_path}/rows/batch={batch}")
    return seen.get["n"]


def move(spark: SparkSession, path: str, archive_path: str, condition: Column, batch: str) -> bool:
    """Rows that meet the condition go to the archive; false if this batch is published already."""
    ledger = read_ledger(spark, path)
    if ledger.filter(F.col("batch").cast("string") == batch).head(1):
        return False
    generation = _newest(spark, path)["generation"] + 1
    kept, moved = changes.archive_split(current(spark, path), condition)
    n = write_moved(moved, archive_path, batch)
    return append_log(kept, path, batch, _facts(generation, n))  # the second phase; its ledger entry, written last, publishes both
