"""State as of a moment: the newest capture of each server, out of tables that hold many.

Captured tables are partitioned by day, capture and set of servers written together, with
the names of each set in a list beside the rows: which captures there are is known without
reading rows, and the number of files does not grow with the number of servers.
``state_as_of`` chooses the newest capture of each server that all tables of a report share,
and each table is read with a filter on its partition columns: no other capture's files are
opened, and a report never pairs two captures.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opslens.functions import dates
from opslens.operators import changes

#: The partition columns of a captured table, and how a capture's moment is spelled in its name.
PARTS = ["captured_date", "capture", "server_set"]
CAPTURE = "yyyyMMdd'T'HHmmss.SSSSSS"
#: Below a table's folder, where its scans do not look: a folder like that of a partition for each set, with its servers and whether they have rows.
LISTS = "_servers/lists"
LISTED = "server_name string, filled boolean"


def as_of_capture(df: DataFrame, as_of: str | datetime, keys: list[str] | None = None, within_days: int | None = None) -> DataFrame:
    """Rows of the newest capture at or before ``as_of`` per server, ``captured_at`` kept.

    For rows that are no catalog table: the newest moments are an aggregate over them, joined
    back. ``within_days`` bounds how old a capture may be; with the column ``captured_date``
    it prunes the daily partitions. Tables of the catalog have ``state_as_of``.
    """
    keys = keys or ["server_name"]
    moment = dates.instant(as_of)
    rows = df.filter(F.col("captured_at") <= moment)
    if within_days is not None:
        oldest = dates.ago(as_of, within_days, "day")
        rows = rows.filter(F.col("captured_at") >= oldest)
        if "captured_date" in df.columns:
            rows = rows.filter(F.col("captured_date").between(oldest.cast("date"), moment.cast("date")))
    newest = rows.groupBy(*keys).agg(F.max("captured_at").alias("_newest"))
    return rows.join(newest, keys).filter(F.col("captured_at") == F.col("_newest")).select(*df.columns)


def lists_folder(spark: SparkSession, table: str) -> str:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table} AS JSON").first()[0]
    return f"{json.loads(described)['location']}/{LISTS}"


def capture_index(spark: SparkSession, table: str) -> DataFrame:
    """(captured_date, capture, server_name, server_set) of every capture of a table, from its lists; no row is read.

    A server that had no rows in a capture is listed too.
    """
    lists = spark.read.schema(f"{LISTED}, captured_date date, capture string, server_set string").parquet(lists_folder(spark, table))
    return lists.select("captured_date", "capture", "server_name", "server_set")


def newest_captures(indexes: list[DataFrame], as_of: str | datetime, within_days: int | None = None) -> DataFrame:
    """The newest capture of each server, at or before ``as_of``, that all the indexes hold."""
    moment = dates.instant(as_of)
    shared = changes.union_all([index.withColumn("_table", F.lit(i)) for i, index in enumerate(indexes)])
    shared = shared.filter((F.col("captured_date") <= moment.cast("date")) & (F.col("capture") <= F.date_format(moment, CAPTURE)))
    if within_days is not None:
        oldest = dates.ago(as_of, within_days, "day")
        shared = shared.filter((F.col("captured_date") >= oldest.cast("date")) & (F.col("capture") >= F.date_format(oldest, CAPTURE)))
    complete = shared.groupBy("captured_date", "capture", "server_name").agg(F.countDistinct("_table").alias("_n")).filter(F.col("_n") == len(indexes))
    return complete.groupBy("server_name").agg(F.max_by(F.struct("captured_date", "capture"), "capture").alias("c")).select("c.*", "server_name")


def _is_in(column: Column, values: list) -> Column:
    found = column.isin([v for v in values if v is not None])
    return found | column.isNull() if None in values else found


def partition_filter(chosen: list[tuple], there: dict[tuple, dict[str | None, set]]) -> Column:
    """The chosen (day, capture, server) as a filter; servers are named only where a set of them is taken in part.

    ``there`` has the sets of each server by (day, capture). Sets are named always: one that is not
    in the lists yet is still being written.
    """
    by_capture = defaultdict(set)
    for day, capture, server in chosen:
        by_capture[day, capture].add(server)
    parts = []
    for (day, capture), servers in sorted(by_capture.items()):
        sets = sorted(set().union(*(there[day, capture][s] for s in servers)))
        part = (F.col("captured_date") == F.lit(day)) & (F.col("capture") == capture)
        part &= F.col("server_set").eqNullSafe(sets[0]) if len(sets) == 1 else F.col("server_set").isin(sets)
        members = {s for s, of in there[day, capture].items() if not of.isdisjoint(sets)}
        parts.append(part if members == servers else part & _is_in(F.col("server_name"), sorted(servers, key=str)))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


@dataclass
class State:
    """Tables of one moment by name, and the capture each server's rows come from."""

    captures: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def stamped(self, report: DataFrame) -> DataFrame:
        """A report with ``captured_at``, which with the server's name is part of every row's key."""
        return report.join(self.captures, "server_name", "left")


def state_as_of(spark: SparkSession, tables: dict[str, str], as_of: str | datetime, within_days: int | None = None) -> State:
    """The tables of a report (name in the report to name in the catalog) as of a moment.

    One row per server comes to the driver, as do the lists of the chosen captures and the
    partitions when Spark plans the scan. A server whose newest capture lacks one of the tables
    is shown as of its newest whole one; a server without any is not shown.
    """
    indexes = {name: capture_index(spark, table) for name, table in tables.items()}
    chosen = [tuple(r) for r in newest_captures(list(indexes.values()), as_of, within_days).collect()]
    captures = {capture for _, capture, _ in chosen}
    state = State(spark.createDataFrame([(server, capture) for _, capture, server in chosen], "server_name string, capture string").select(
                      "server_name", F.to_timestamp_ntz("capture", F.lit(CAPTURE)).alias("captured_at")))
    for name, table in tables.items():
        there = defaultdict(lambda: defaultdict(set))
        for day, capture, server, of in indexes[name].filter(F.col("capture").isin(sorted(captures))).collect():
            there[day, capture][server].add(of)
        rows = spark.table(table).filter(partition_filter(chosen, there))
        state.tables[name] = rows.select(*[c for c in rows.columns if c not in ("server_name", "captured_at", *PARTS)], "server_name")
    return state
