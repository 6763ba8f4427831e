"""Streaming jobs. Functions take and return stream DataFrames; the same call works on a batch
where Spark allows it, and each has a batch twin among the reports otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from opslens.functions import codes
from opslens.plans import logs
from opslens.session import new_folder
from opslens.sources.schemas import EVENT_STREAM
from opslens.sources.sinks import append_log, read_ledger, read_log
from opslens.streaming import processors, state


def read_stream(spark: SparkSession, path: str, schema: str = EVENT_STREAM, files_per_batch: int | None = None) -> DataFrame:
    """Files arriving at a path (wildcards allowed) as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def start(df: DataFrame, folder: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Starts a job that keeps its results below ``folder``, as a log with a ledger of micro-batches.

    A micro-batch that is run again after a failure leaves every row once, and rows of one
    that has not ended are not shown. Without ``every`` the job works off what is there and ends.
    """
    writer = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
              .foreachBatch(lambda rows, batch: append_log(rows, folder, batch)))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def results(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """What a job has written, with the number of the micro-batch."""
    return read_log(spark, folder, df.schema, "long")


def run_to_end(df: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a job over what is there and returns its rows."""
    spark = df.sparkSession
    spark.conf.set(MERGE_SESSIONS, "true")  # sessions of a task are merged before they are shuffled
    where = folder or new_folder(spark, "stream")
    start(df, where, mode).awaitTermination()
    return results(spark, df, where)


def newest_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows updated by several micro-batches the newest per key."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


# -- capture ------------------------------------------------------------------------------------

LEAST_SEVERITY, IGNORED_ERROR = 10, 17830


def failing_queries(events: DataFrame) -> DataFrame:
    """Errors worth keeping: above the least severity and not the ignored number."""
    return events.filter((F.col("severity") > LEAST_SEVERITY) & (F.col("error_number") != IGNORED_ERROR))


def capture_failing_queries(events: DataFrame, folder: str, every: str | None = "5 seconds") -> StreamingQuery:
    return start(failing_queries(events), folder, every=every)


def probe_failures(probes: DataFrame) -> DataFrame:
    return logs.probe_failures(probes)


# -- windows ------------------------------------------------------------------------------------

def _with_event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarked stream; event time must be an instant, so zone-less times count as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _zoneless(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


def event_counts(events: DataFrame, keys: list[str], ts: str, width: str, slide: str | None = None,
                 late: str = "10 minutes") -> DataFrame:
    """Events per time window and keys; rows later than ``late`` are not counted in a stream."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = _with_event_time(events, ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(_zoneless("w.start").alias("window_start"), _zoneless("w.end").alias("window_end"), *keys, "n")


def counts_with_late(events: DataFrame, keys: list[str], ts: str, width: str, folder: str, slide: str | None = None,
                     late: str = "10 minutes", every: str | None = None) -> StreamingQuery:
    """Events per window and keys where late rows are counted too, apart.

    Each micro-batch leaves its own counts, split into rows in time and late ones: those more
    than ``late`` behind the newest event of the batches before it, which the ledger knows.
    Nothing is held in memory from batch to batch; ``corrected_counts`` adds the parts up.
    """
    spark = events.sparkSession
    window = F.window("_at", width, slide) if slide else F.window("_at", width)

    def write(rows: DataFrame, batch: int) -> None:
        ledger = read_ledger(spark, folder)
        newest = None if ledger is None else ledger.filter(F.col("batch").cast("long") < batch).agg(F.max("newest").alias("t")).first()["t"]
        behind = F.lit(False) if newest is None else F.col("_at") < F.lit(newest) - F.expr(f"INTERVAL {late}")
        stamped = rows.withColumn("_at", F.col(ts).cast("timestamp")).withColumn("late", F.coalesce(behind, F.lit(False)))
        counted = stamped.groupBy(window.alias("w"), *keys, "late").agg(F.count(F.lit(1)).alias("n"), F.max("_at").alias("newest"))
        counted = counted.select(_zoneless("w.start").alias("window_start"), _zoneless("w.end").alias("window_end"), *keys, "late", "n", "newest")
        append_log(counted, folder, batch, {"newest": F.max("newest")})

    writer = events.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def corrected_counts(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Per window and keys the events counted in time, those that came late, and all of them."""
    parts = read_log(spark, folder)
    counted = parts.groupBy("window_start", "window_end", *keys)
    return counted.agg(F.sum(F.when(~F.col("late"), F.col("n")).otherwise(0)).alias("counted"),
                       F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("late"), F.sum("n").alias("n"))


def outages(failures: DataFrame, keys: list[str], ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Failures closer together than ``gap`` as one outage per key.

    Outages are mergeable: a task merges its failures into outages first, and only these are
    shuffled (``MERGE_SESSIONS``, which ``run_to_end`` sets), so a server that fails all the time
    sends a few rows. In append mode an outage is given once, when no row can lengthen it.
    """
    grouped = _with_event_time(failures, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("failures")).select(
        *keys, _zoneless("w.start").alias("outage_start"), _zoneless("w.end").alias("outage_end"), "failures")


def _key_text(df: DataFrame, keys: list[str]) -> Column:
    """Values of some columns as one text, equal only where all of them are; nulls are equal."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}

    def text(name: str) -> Column:
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, (T.ArrayType, T.StructType)):
            return F.to_json(c, exact)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return (c + F.lit(0.0).cast(kind)).cast("string")  # one zero
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(c).cast("string")
        return F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(text(k)).cast("string"), F.lit(":"), text(k)), F.lit("-")) for k in keys])


def suppress_duplicates(events: DataFrame, keys: list[str], ts: str, quiet_seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """Events with no equal one in the ``quiet_seconds`` before them, by event time.

    The answer follows from the times alone, so it is the same however the rows are dealt
    to micro-batches, as long as they come in order; a row later than ``late`` is left out.
    """
    rows = _with_event_time(events, ts, late)
    dealt = rows.withColumn(state.KEY, _key_text(rows, keys)).withColumn(
        state.LOT, F.pmod(F.xxhash64(state.KEY), F.lit(state.LOTS)).cast("int"))
    found = dealt.groupBy(state.LOT).applyInPandasWithState(
        state.first_of_equals(ts, quiet_seconds), rows.schema, state.LAST_SEEN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn(ts, _zoneless(ts))


# -- state --------------------------------------------------------------------------------------

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed_state(spark: SparkSession) -> None:
    """Values, lists and timers per key live in this state store only."""
    spark.conf.set(STATE_STORE, ROCKS)


def _times_zoneless(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _zoneless(c) for c in columns})


def milestone_history(milestones: DataFrame) -> DataFrame:
    """What reports of milestones have announced so far, as the state a stream starts from: one row per job."""
    told = F.max(F.when(F.col("announced"), F.col("sampled_at").cast("timestamp")))
    return milestones.groupBy("server_name", "job_id").agg(F.max("milestone").cast("long").alias("milestone"), told.alias("announced_at"))


def milestones(samples: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Progress milestones as they are reached; state per job is the last one and its announcement.

    ``history`` (see ``milestone_history``) is read when the job starts for the first time:
    what it holds is not announced again. A restarted job goes on from its own state.
    """
    _keyed_state(samples.sparkSession)
    start = None if history is None else history.groupBy("server_name", "job_id")
    rows = samples.withColumn("sampled_at", F.col("sampled_at").cast("timestamp"))
    found = rows.groupBy("server_name", "job_id").transformWithStateInPandas(
        processors.Milestones(), processors.MILESTONE_ROWS, "append", "None", start)
    return _times_zoneless(found, "sampled_at")


def alert_responses(matches: DataFrame, delay_seconds: int = codes.ALERT_DELAY_SECONDS, late: str = "1 hour") -> DataFrame:
    """Alert matches that lead to a response; state per server and rule is the last response, dropped when it is past.

    A match later than ``late`` is left out.
    """
    _keyed_state(matches.sparkSession)
    rows = _with_event_time(matches, "event_time", late)
    found = rows.groupBy("server_name", "rule").transformWithStateInPandas(
        processors.RateLimit(delay_seconds), processors.RESPONSE_ROWS, "append", "EventTime")
    return _times_zoneless(found, "event_time")


def rule_responses(events: DataFrame, rules: DataFrame, delay_seconds: int = codes.ALERT_DELAY_SECONDS, late: str = "1 hour") -> DataFrame:
    """Responses to a stream of events under a table of rules.

    The rules are the static side of the joins. A job takes up changed rules when it is
    started again; the state of rules that stayed goes on.
    """
    return alert_responses(logs.alert_matches(events, rules), delay_seconds, late)


def counter_rates(counters: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counter change per second, however the samples arrive: they wait ``late`` for earlier ones.

    A sample that comes even later is left out; ``counts_with_late`` tells how many there are.
    """
    _keyed_state(counters.sparkSession)
    rows = _with_event_time(counters, "captured_at", late)
    found = rows.groupBy("server_name", "counter_name", "instance_name").transformWithStateInPandas(
        processors.OrderedRates(), processors.RATE_ROWS, "append", "EventTime")
    return _times_zoneless(found, "captured_at")
