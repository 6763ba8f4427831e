"""Readers of captured tables, logs, traces, event files and inventories."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from opslens.functions import xmls
from opslens.operators import adjacent, captures, changes
from opslens.sources.schemas import SCHEMAS, schema_of
from opslens.sources.sinks import scratch_table

# Executors get the functions below with the tasks; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_table(spark: SparkSession, folder: str, name: str, since: str | None = None) -> DataFrame:
    """Captured table; ``since`` prunes the daily partitions before anything is read."""
    if name not in SCHEMAS:
        raise KeyError(f"no schema for {name}")
    df = spark.read.schema(f"{schema_of(name)}, captured_at timestamp_ntz, captured_date date").parquet(f"{folder}/{name}")
    return df if since is None else df.filter(F.col("captured_date") >= F.lit(since).cast("date"))


def read_state(spark: SparkSession, folder: str, name: str, as_of: str | datetime, within_days: int | None = None) -> DataFrame:
    """A captured table as of a moment, with the columns a report joins on: the newest capture of each server.

    Tables of the catalog have ``captures.state_as_of``, which opens no other capture's files.
    """
    return captures.as_of_capture(read_table(spark, folder, name), as_of, within_days=within_days).drop("captured_at", "captured_date")


def read_fleet(spark: SparkSession, servers: list[str], read_one: Callable[[SparkSession, str], DataFrame]
               ) -> tuple[DataFrame | None, DataFrame]:
    """The same read on every server, rows tagged with the server.

    A server that cannot be reached does not fail the others: it becomes a row
    of the second result ``(server_name, error)``.
    """
    parts, errors = [], []
    for server in servers:
        try:
            parts.append(read_one(spark, server).withColumn("server_name", F.lit(server)))
        except Exception as error:  # any failure to open this one server
            errors.append((server, str(error).splitlines()[0]))
    failed = spark.createDataFrame(errors, "server_name string, error string")
    return (changes.union_all(parts) if parts else None), failed


def fetch_fleet(spark: SparkSession, servers: list[str], fetch: Callable[[str], Iterable[dict]], schema: str
                ) -> tuple[DataFrame, DataFrame]:
    """What ``fetch`` yields on every server, and a row ``(server_name, error)`` for each server that failed.

    The servers are dealt over the executors, one call each; a failure at run time, also
    half way through, becomes a row and the other servers' rows arrive. The answers are
    written below the shared folder once, so no server is asked twice.
    """
    fields = spark.createDataFrame([], schema).schema
    names = fields.names

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for server in frame["server_name"]:
                rows, error = [], None
                try:
                    rows = list(fetch(server))
                except Exception as failure:  # any failure of this one server
                    rows, error = [], (str(failure).splitlines() or [type(failure).__name__])[0]
                out = pd.DataFrame([{n: row.get(n) for n in names} for row in rows] or [dict.fromkeys(names)], columns=names, dtype=object)
                yield out.assign(server_name=server, error=error, is_row=bool(rows))

    types = T.StructType([*fields.fields, *T.StructType.fromDDL("server_name string, error string, is_row boolean").fields])
    asked = spark.createDataFrame([(s,) for s in servers], "server_name string").repartition(max(1, len(servers)))
    answers = scratch_table(asked.mapInPandas(ask, types), "fleet")
    return answers.filter("is_row").drop("error", "is_row"), answers.filter("error is not null").select("server_name", "error")


def jdbc_reader(url_of: Callable[[str], str], query: str, **options: str) -> Callable[[SparkSession, str], DataFrame]:
    """A ``read_one`` for :func:`read_fleet` that runs a query on a server."""
    settings = {"queryTimeout": "600", "loginTimeout": "15", **options}

    def read(spark: SparkSession, server: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url_of(server), query=query, **settings).load()

    return read


def per_database(df: DataFrame, database: str | None = None) -> DataFrame:
    """Rows of every database, or of one; the name is a column of the capture."""
    return df if database is None else df.filter(F.col("database_name") == database)


def read_xe(spark: SparkSession, path: str) -> DataFrame:
    """Extended-event files (wildcards allowed): one row per event, parsed once.

    ``server_name`` comes from a folder ``server_name=...``. The reports on events take
    these rows as well as documents in a column.
    """
    rows = spark.read.format("xml").option("rowTag", "event").schema(xmls.EVENT_COLUMNS).load(path)
    rows = rows.withColumn("server_name", server_of(F.col("_metadata.file_path")))
    event = F.struct(*[F.col(c) for c in ("_name", "_timestamp", "data", "action")])
    return (rows.withColumn("event", event).withColumn("event_name", F.col("_name"))
            .withColumn("event_time", xmls.event_time(F.col("event"))).select("server_name", "event", "event_name", "event_time"))


def read_ring_buffer(spark: SparkSession, path: str) -> DataFrame:
    """Saved ring buffer targets: the events inside them are read the same way."""
    return read_xe(spark, path)


def read_trace(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All converted trace files of a folder in one scan, with the file they came from."""
    rows = spark.read.schema(schema_of("trace")).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("trace_file", F.col("_metadata.file_name"))


# Layout of an error log line and of an archive's file name.
LOG_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?)\s+(\S+)\s+(.*)$"
ARCHIVE_NAME = r"ERRORLOG\.(\d+)$"


def read_errorlog(spark: SparkSession, path: str, since: str | datetime | None = None) -> DataFrame:
    """Current and archived error logs with their number; old archives are not opened.

    A line without a time of its own continues the entry before it in its file and has
    that entry's time and process. ``server_name`` comes from a folder ``server_name=...``.
    """
    reader = spark.read
    if since is not None:
        moment = since if isinstance(since, str) else since.isoformat()
        reader = reader.option("modifiedAfter", moment.replace(" ", "T"))
    lines = numbered_lines(reader.text(path))
    number = F.regexp_extract("file", ARCHIVE_NAME, 1)
    is_entry = F.col("value").rlike(LOG_LINE)

    def part(group: int) -> Column:
        return F.when(is_entry, F.regexp_extract("value", LOG_LINE, group))

    entry = F.when(is_entry, F.struct(part(1).try_cast("timestamp_ntz").alias("log_date"), part(2).alias("spid")))
    rows = adjacent.carry_forward(lines, ["file"], "line_no", entry, adjacent.line_bucket("line_no"), "entry")
    return rows.select(
        server_of(F.col("file")).alias("server_name"),
        F.coalesce(F.nullif(number, F.lit("")).cast("long"), F.lit(0)).alias("log_id"), "line_no",
        "entry.log_date", "entry.spid", F.coalesce(part(3), F.col("value")).alias("log_msg"))


def server_of(path: Column) -> Column:
    """The server a captured file belongs to, from a folder ``server_name=...`` of its path; else null."""
    return F.nullif(F.regexp_extract(path, r"server_name=([^/\\\\]+)", 1), F.lit(""))


def numbered_lines(text: DataFrame) -> DataFrame:
    """(file, line_no, value) of text files read by Spark.

    A line's number is the byte at which its block starts and its place in the block: it
    grows along a file whatever blocks the file is read in. A file in one block counts from 0.
    """
    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_id"))
    of_block = Window.partitionBy("file", "_block")
    return rows.select("file", (F.col("_block") + F.col("_id") - F.min("_id").over(of_block)).alias("line_no"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines captured with file and line number (the order is written at capture)."""
    return spark.read.schema(SCHEMAS["lines"]).parquet(path)


def printed_output(lines: DataFrame) -> DataFrame:
    """(server_name, line, output) of what servers printed, from captured lines; a blank line is null.

    The server is that of the lines, where they carry one, else the one their file belongs to.
    """
    server = F.coalesce(F.col("server_name"), server_of(F.col("file"))) if "server_name" in lines.columns else server_of(F.col("file"))
    return lines.select(server.alias("server_name"), F.col("line_no").alias("line"), F.when(F.trim("line") != "", F.col("line")).alias("output"))


# Lines of a printed directory listing.
DIRECTORY_LINE = r"^\s*Directory of\s+(.*?)\s*$"
FILE_LINE = r"^(\d\d/\d\d/\d{4}\s+\d\d:\d\d [AP]M)\s+(\d+) (.+)$"


def directory_listing(lines: DataFrame) -> DataFrame:
    """Files of printed directory listings ``(file, line_no, line)``.

    The path is put together from the latest directory line and the name at the
    end of a file line; all other lines (headers, totals) fall away.
    """
    directory = F.nullif(F.regexp_extract("line", DIRECTORY_LINE, 1), F.lit(""))
    rows = adjacent.carry_forward(lines, ["file"], "line_no", directory, adjacent.line_bucket("line_no"), "directory")

    def part(group: int) -> Column:
        return F.regexp_extract("line", FILE_LINE, group)

    return rows.filter(F.col("line").rlike(FILE_LINE)).select(
        "file", F.concat(F.col("directory"), F.lit("\\"), part(3)).alias("path"), part(2).cast("long").alias("length"),
        F.to_timestamp(F.regexp_replace(part(1), r"\s+", " "), "MM/dd/yyyy hh:mm a").cast("timestamp_ntz").alias("modified"))


def read_file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with size and time, and their server; their content is never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(path))
    return files.select(server_of(F.col("path")).alias("server_name"), "path", "length",
                        F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


# Fixed value: how the first line of a counter file begins.
HEADER_LINE = r'^\s*"\(PDH-'


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Performance-counter log in CSV form: one column per counter to one row per sample.

    The first column is the time; the others are named ``\\\\server\\object(instance)\\counter``.
    A file may have several headers (counters were added): each names the samples up to the next.
    """
    lines = numbered_lines(spark.read.text(path)).filter(F.trim("value") != "")
    cells = F.split(F.regexp_replace("value", r'^\s*"|"\s*$', ""), '"\\s*,\\s*"')
    is_header = F.col("value").rlike(HEADER_LINE)
    named = adjacent.carry_forward(lines.withColumn("_values", cells).withColumn("_header", is_header), ["file"], "line_no", F.when(F.col("_header"), F.col("_values")),
                                   adjacent.line_bucket("line_no"), "_names")
    rows = (named.filter(~F.col("_header") & F.col("_names").isNotNull())  # a header names the samples up to the next one
            .select(F.element_at("_values", 1).alias("_at"), F.explode(F.arrays_zip(
                F.slice("_names", 2, F.size("_names")).alias("name"), F.slice("_values", 2, F.size("_names")).alias("value"))).alias("_c"))
            .select("_at", F.col("_c.name").alias("_counter"), F.col("_c.value").alias("_value")))
    name = F.col("_counter")
    return rows.select(
        F.regexp_extract(name, r"^\\\\([^\\]+)\\", 1).alias("server_name"),
        F.try_to_timestamp("_at", F.lit("MM/dd/yyyy HH:mm:ss.SSS")).cast("timestamp_ntz").alias("captured_at"),
        F.regexp_extract(name, r"([^\\]+\\[^\\]+)$", 1).alias("_path"), F.trim("_value").try_cast("double").alias("value"),
    ).select("server_name", "captured_at", F.regexp_replace("_path", r"\([^()]*\)\\", r"\\").alias("counter_name"),
             F.regexp_extract("_path", r"\(([^()]*)\)\\", 1).alias("instance_name"), "value")


def values_df(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline constant table."""
    return spark.createDataFrame(rows, schema)


def run_sql(spark: SparkSession, query: str, params: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Parameterised query; ``{name}`` refers to a DataFrame, ``:name`` to a parameter."""
    return spark.sql(query, args=params or {}, **frames)
