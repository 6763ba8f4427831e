"""Registered streaming jobs, each run over the whole event file, and list reports."""

from pyspark.sql import DataFrame, functions as F

from opslens.bindings.dialect import SparkSpelling
from opslens.bindings.tables import TABLES
from opslens.operators import changes
from opslens.plans import lists, logs, workload
from opslens.registry import availability as ha_registry, logs as log_registry, workload as workload_registry
from opslens.registry.common import Query
from opslens.session import new_folder
from opslens.streaming import jobs


def events_stream(t) -> DataFrame:
    """The event file as a stream (a path with a wildcard, as files arrive in a folder)."""
    return jobs.read_stream(t.spark, f"{t.folder}/events*.parquet")


def event_counts(t) -> DataFrame:
    keys = ["window_start", "window_end", "event_type"]
    parts = []
    for kind, slide in (("tumbling", None), ("sliding", "15 minutes")):
        counted = jobs.event_counts(events_stream(t), ["event_type"], "ts", "1 hour", slide)
        rows = jobs.newest_per_key(jobs.run_to_end(counted, "update"), keys)
        parts.append(rows.withColumn("kind", F.lit(kind)))
    return changes.union_all(parts)


def over_stream(t, name: str, events: DataFrame) -> DataFrame:
    """A bound table over a stream of events."""
    return t.spark.sql(TABLES[name](SparkSpelling()), events=events)


BEAT = "beat"


def shuffled_events(t, parts: int = 4) -> DataFrame:
    """The event file dealt over files in no order, then one event far ahead that lets the watermark pass all others."""
    folder = new_folder(t.spark, "events")
    t.events.repartition(parts, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("event_id", "ts")).write.parquet(folder)
    beat = t.spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.expr("TIMESTAMP_NTZ'2034-01-01 00:00:00'").alias("ts"), F.lit(0).cast("long").alias("user_id"),
                                   F.lit(BEAT).alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    beat.coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_stream(t.spark, folder, files_per_batch=1)


LATE = "40 days"  # the event file covers 30


def outages(t) -> DataFrame:
    keyed = shuffled_events(t).filter(F.col("event_type").isin("error", BEAT)).withColumn(
        "server_name", F.when(F.col("event_type") == BEAT, BEAT).otherwise(F.concat(F.lit("srv_"), (F.col("user_id") % 4).cast("string"))))
    rows = jobs.run_to_end(jobs.outages(keyed, ["server_name"], "ts", late=LATE))
    return rows.filter(F.col("server_name") != BEAT).drop("batch")


def late_counts(t) -> DataFrame:
    """Hourly and sliding counts over files that come in no order; most rows are late, and counted."""
    parts = []
    for kind, slide in (("tumbling", None), ("sliding", "15 minutes")):
        folder = new_folder(t.spark, "late-counts")
        jobs.counts_with_late(shuffled_events(t), ["event_type"], "ts", "1 hour", folder, slide).awaitTermination()
        rows = jobs.corrected_counts(t.spark, folder, ["event_type"]).filter("event_type <> 'beat' and counted + late = n")
        parts.append(rows.select("window_start", "window_end", "event_type", "n", F.lit(kind).alias("kind")))
    return changes.union_all(parts)


def counter_rates(t) -> DataFrame:
    rows = jobs.run_to_end(jobs.counter_rates(over_stream(t, "counters", shuffled_events(t)), late=LATE))
    return rows.filter(F.col("counter_name") != BEAT).drop("batch")


def alert_responses(t) -> DataFrame:
    return jobs.run_to_end(jobs.alert_responses(logs.alert_matches(over_stream(t, "alert_events", events_stream(t))), 3600)).drop("batch")


HALFWAY = "2024-01-16 00:00:00"


def milestones(t) -> DataFrame:
    """The first half of the samples is history, reported as a batch; the stream goes on from there."""
    old, new = (t.progress.filter(F.col("sampled_at").cast("timestamp") < HALFWAY), t.progress.filter(F.col("sampled_at").cast("timestamp") >= HALFWAY))
    before = workload.progress_milestones(old).withColumn("milestone", F.col("milestone").cast("long"))
    folder = new_folder(t.spark, "samples")
    new.write.parquet(folder)
    rows = jobs.run_to_end(jobs.milestones(t.spark.readStream.schema(new.schema).parquet(folder), jobs.milestone_history(before)))
    return before.unionByName(rows.drop("batch"))


def duplicates(t) -> DataFrame:
    keyed = events_stream(t).select("ts", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    rows = jobs.run_to_end(jobs.suppress_duplicates(keyed, ["user_id", "event_type", "k"], "ts"))
    return rows.select("user_id", "event_type", "k", "ts")


def archive_split(t) -> DataFrame:
    kept, moved = changes.archive_split(t.orders, F.year("o_orderdate") <= 1996)
    return kept.withColumn("placed", F.lit("kept")).unionByName(moved.withColumn("placed", F.lit("archived")))


STYLE_SQL = {101: "%m/%d/%Y", 102: "%Y.%m.%d", 103: "%d/%m/%Y", 104: "%d.%m.%Y", 108: "%H:%M:%S", 111: "%Y/%m/%d",
             112: "%Y%m%d", 120: "%Y-%m-%d %H:%M:%S", 126: "%Y-%m-%dT%H:%M:%S"}
PICTURE_SQL = {"month_year": "%B, %Y", "short_month": "%b-%Y", "weekday": "%A %B %-d", "arrows": "%Y -> %m -> %d",
               "hours_minutes": "%-Ih, %-Mm"}

EVENT_COUNTS = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
          event_type, count(*) AS n, 'tumbling' AS kind FROM events GROUP BY 1, 2, 3
        UNION ALL
        SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE
          + INTERVAL 1 HOUR, event_type, count(*), 'sliding' FROM events, range(4) r(k) GROUP BY 1, 2, 3"""

QUERIES = {
    "stream_event_counts": Query(
        event_counts,
        EVENT_COUNTS),
    "stream_late_counts": Query(late_counts, EVENT_COUNTS),
    "stream_counter_rates": Query(counter_rates, f"SELECT * EXCLUDE (rate_millions) FROM ({ha_registry.QUERIES['counter_rate'].sql})"),
    "stream_alert_responses": Query(alert_responses, log_registry.QUERIES["alert_rate_limited"].sql),
    "stream_milestones": Query(milestones, workload_registry.MILESTONES),
    "stream_outages": Query(
        outages,
        """WITH f AS (SELECT 'srv_' || (user_id % 4) AS server_name, ts FROM events WHERE event_type = 'error'),
        g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM f WINDOW w AS (PARTITION BY server_name ORDER BY ts)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY server_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
        SELECT server_name, min(ts) AS outage_start, max(ts) + INTERVAL 30 MINUTE AS outage_end, count(*) AS failures
        FROM i GROUP BY server_name, island"""),
    "stream_dedup": Query(
        duplicates,
        """WITH e AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, ts FROM events),
          o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type, k ORDER BY ts) AS before FROM e)
        SELECT user_id, event_type, k, ts FROM o WHERE before IS NULL OR ts > before + INTERVAL 1 HOUR"""),
    "archive_split": Query(
        archive_split,
        """SELECT *, 'archived' AS placed FROM orders WHERE year(o_orderdate) <= 1996
        UNION ALL SELECT *, 'kept' FROM orders WHERE year(o_orderdate) > 1996"""),
    "split_list": Query(
        lambda t: lists.split_list(t.documents.select("doc_id", "text"), "text"),
        """SELECT doc_id, generate_subscripts(string_split(text, ','), 1) AS item_no, unnest(string_split(text, ',')) AS item FROM documents"""),
    "timestamp_formats": Query(
        lambda t: lists.timestamp_formats(
            t.orders.selectExpr("o_orderkey", "timestampadd(SECOND, o_orderkey % 86400, o_orderdate) AS at"), "at"),
        f"""WITH o AS (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS st FROM orders)
        SELECT o_orderkey, st AS "at", {', '.join(f"strftime(st, '{f}') AS style_{s}" for s, f in STYLE_SQL.items())},
          {', '.join(f"strftime(st, '{f}') AS {n}" for n, f in PICTURE_SQL.items())} FROM o"""),
}
