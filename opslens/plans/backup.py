"""Backup and restore reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions import codes, dates, numbers, text
from opslens.operators import adjacent, changes, pivots, ranking

DB = ["server_name", "database_name"]
DB_TYPE = [*DB, "type"]
# Backups are rarer than events: an hour of one database and type is few rows.
HOUR = 3600


def _without_copy_only(backupset: DataFrame) -> DataFrame:
    """Copy-only backups left out; old captures have no such column."""
    return backupset.filter(~F.col("is_copy_only")) if "is_copy_only" in backupset.columns else backupset


def _started_within(backupset: DataFrame, as_of, days: int) -> DataFrame:
    return backupset.filter(F.col("backup_start_date") > dates.ago(as_of, days, "day"))


def operation_eta(requests: DataFrame, texts: DataFrame, as_of: str | datetime) -> DataFrame:
    """Operations that report progress, with time left, finish time and statement."""
    running = requests.filter("percent_complete <> 0").join(
        texts, ["server_name", "sql_handle"], "left")
    left = F.col("estimated_completion_time")
    return running.select(
        "server_name", "session_id", "request_id", "percent_complete",
        dates.millis_clock(left).alias("remaining"),
        dates.add("millisecond", left, dates.instant(as_of)).alias("eta"),
        text.running_statement(F.col("text"), F.col("statement_start_offset"),
                               F.col("statement_end_offset")).alias("statement"),
        "start_time", "command")


def backup_frequency(backupset: DataFrame, as_of: str | datetime, days: int = 30,
                     previous_days: int = 40) -> DataFrame:
    """Average hours between a backup and the one before it, per database and type.

    The earlier backup is looked up through time buckets, so no database fills
    a task.
    """
    starts = _started_within(_without_copy_only(backupset), as_of, previous_days).select(
        *DB_TYPE, "backup_start_date")
    pairs = adjacent.with_earlier_time(starts, DB_TYPE, "backup_start_date",
                                       adjacent.time_bucket("backup_start_date", HOUR))
    minutes = dates.boundary_diff("minute", F.col("prev_backup_start_date"), F.col("backup_start_date"))
    return _started_within(pairs, as_of, days).groupBy(*DB_TYPE).agg(F.avg(minutes / 60.0).alias("avg_hours"))


def device_class(name: Column, device: Column, device_type: Column) -> Column:
    return (F.when(name.contains("Veeam"), "Snapshot")
            .when(device.rlike(r"^\{.*\}"), "Snapshot")
            .when(device.startswith("Legato#"), "Networker")
            .when(device.startswith("TDPSQL"), "Tivoli")
            .when(device.rlike("^.:"), "Native")
            .when(device.startswith("\\\\"), "Native")
            .when(device.startswith("VNBU"), "NetBackup")
            .when(device_type == 7, "Other")
            .otherwise(device))


def backup_devices(backupset: DataFrame, media: DataFrame, as_of: str | datetime,
                   days: int = 30) -> DataFrame:
    """Backups per database, device class and type."""
    recent = _started_within(_without_copy_only(backupset), as_of, days)
    return (recent.join(media, ["server_name", "media_set_id"])
            .withColumn("dev", device_class(F.col("name"), F.col("physical_device_name"),
                                            F.col("device_type")))
            .groupBy(*DB, "dev", "type").agg(F.count("*").alias("cnt")))


def dominant_device(devices: DataFrame) -> DataFrame:
    """Device classes no other class of the database and type outnumbers; ties stay."""
    return ranking.latest_rows(devices, DB_TYPE, [F.desc("cnt")], ties=True)


def backup_frequency_wide(backupset: DataFrame, media: DataFrame, as_of: str | datetime,
                          days: int = 30, previous_days: int = 40) -> DataFrame:
    """Hours and device of full, log and differential backups in one row per database."""
    hours = backup_frequency(backupset, as_of, days, previous_days).withColumn(
        "dev", F.lit(None).cast("string"))
    device = (dominant_device(backup_devices(backupset, media, as_of, days))
              .groupBy(*DB_TYPE).agg(F.min("dev").alias("dev")))
    both = changes.update_from(hours, device, DB_TYPE, ["dev"])

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("type") == kind, F.col(column)))

    wide = both.groupBy(*DB).agg(
        F.max(F.when(F.col("type") == "D", 1)).alias("_has_full"),
        *[of(k, c).alias(a) for k in ("D", "L", "I")
          for c, a in (("dev", f"dev_{k.lower()}"), ("avg_hours", f"hours_{k.lower()}"))])
    return wide.filter("_has_full = 1").drop("_has_full")


def _history_rows(backupset: DataFrame) -> DataFrame:
    """Data backups that are not both copy-only and snapshot."""
    return backupset.filter((~F.col("is_copy_only") | ~F.col("is_snapshot")) & (F.col("type") != "L"))


LSN_COLUMNS = ["checkpoint_lsn", "database_backup_lsn", "differential_base_lsn", "first_lsn",
               "fork_point_lsn", "last_lsn"]


def backup_history(backupset: DataFrame, media: DataFrame, as_of: str | datetime,
                   days: int = 1) -> DataFrame:
    """Data backups of the last days with duration, sizes and device."""
    recent = _history_rows(backupset).filter(
        F.col("backup_start_date") >= dates.ago(as_of, days, "day"))
    return recent.join(media, ["server_name", "media_set_id"]).select(
        *DB, "backup_set_id", "backup_start_date", "backup_finish_date",
        text.duration_text(F.col("backup_start_date"), F.col("backup_finish_date")).alias("duration"),
        codes.decode(F.col("type"), codes.BACKUP_TYPES).alias("backup_type"),
        numbers.bytes_to_gb(F.col("compressed_backup_size")).alias("compressed_backup_size_gb"),
        numbers.bytes_to_gb(F.col("backup_size")).alias("backup_size_gb"),
        "physical_device_name", "user_name", "is_copy_only", "is_snapshot",
        *[c for c in LSN_COLUMNS if c in backupset.columns])


def last_backups(backupset: DataFrame, databases: DataFrame, media: DataFrame,
                 as_of: str | datetime, hours: int = 596) -> DataFrame:
    """Last backup per database, type and user, with run time, age and compression ratio."""
    finish = F.col("backup_finish_date")
    backupset = backupset.filter(finish >= dates.ago(as_of, hours, "hour"))  # keeps every maximum that is recent
    last = (_without_copy_only(backupset).groupBy(*DB_TYPE, "user_name")
            .agg(F.max(finish).alias("backup_finish_date")))
    rows = last.join(backupset.drop("user_name", "name"), [*DB_TYPE, "backup_finish_date"])
    known = databases.select("server_name", F.col("name").alias("database_name"))
    return (rows.join(known, DB).join(media, ["server_name", "media_set_id"]).select(
        *DB_TYPE, "backup_finish_date",
        text.duration_text(F.col("backup_start_date"), finish).alias("run_time"),
        text.duration_text(finish, dates.instant(as_of)).alias("time_since_backup"),
        numbers.bytes_to_gb(F.col("backup_size")).alias("backup_size_gb"),
        numbers.bytes_to_gb(F.col("compressed_backup_size")).alias("compressed_backup_size_gb"),
        numbers.exact_div(F.col("backup_size"), F.col("compressed_backup_size"), 2).alias("compression_ratio"),
        "physical_device_name", "user_name"))


def stale_backups(backupset: DataFrame, databases: DataFrame, as_of: str | datetime,
                  hours: int = 48) -> DataFrame:
    """Databases whose last full backup is old, and databases never backed up."""
    last = F.col("last_db_backup_date")
    stale = (backupset.filter("type = 'D'").groupBy(*DB)
             .agg(F.max("backup_finish_date").alias("last_db_backup_date"))
             .filter(last < dates.ago(as_of, hours, "hour"))
             .withColumn("backup_age_hours", dates.boundary_diff("hour", last, dates.instant(as_of))))
    never = (databases.filter("name <> 'tempdb' and state_desc <> 'OFFLINE'")
             .select("server_name", F.col("name").alias("database_name"))
             .join(backupset.select(*DB).distinct(), DB, "left_anti")
             .select(*DB, F.lit(None).cast("timestamp_ntz").alias("last_db_backup_date"),
                     F.lit(9999).cast("long").alias("backup_age_hours")))
    return stale.unionByName(never).distinct()


def latest_by_type(backupset: DataFrame, as_of: str | datetime) -> DataFrame:
    """Latest backup per database and type with minutes taken and minutes since."""
    newest = ranking.latest_rows(
        backupset.select(*DB_TYPE, "user_name", "backup_start_date", "backup_finish_date",
                         "recovery_model"),
        DB_TYPE, [F.desc("backup_finish_date")], ties=True)
    start, finish = F.col("backup_start_date"), F.col("backup_finish_date")
    return newest.select(
        *DB, codes.decode(F.col("type"), codes.BACKUP_TYPES_UPPER).alias("type"), "user_name",
        "backup_start_date", "backup_finish_date",
        dates.boundary_diff("minute", start, finish).alias("backup_minutes"),
        dates.boundary_diff("minute", finish, dates.instant(as_of)).alias("minutes_since"),
        "recovery_model")


def missing_backup_days(backupset: DataFrame, databases: DataFrame, as_of: str | datetime,
                        days: int = 4) -> DataFrame:
    """Online databases and the past days on which no full backup of them began.

    Each database row is exploded over the calendar; there is no cross join.
    """
    today = dates.instant(as_of).cast("date")
    calendar = F.sequence(F.date_sub(today, days), F.date_sub(today, 1))
    expected = (databases.filter("state_desc = 'ONLINE' and name <> 'tempdb'")
                .select("server_name", F.col("name").alias("database_name"), "state_desc",
                        "is_in_standby", "is_read_only", F.explode(calendar).alias("day")))
    done = (_started_within(backupset.filter("type = 'D'"), as_of, days)
            .select(*DB, F.col("backup_start_date").cast("date").alias("day")).distinct())
    return expected.join(done, [*DB, "day"], "left_anti")


def agent_backups(backupset: DataFrame, services: DataFrame, media: DataFrame, databases: DataFrame,
                  as_of: str | datetime, days: int = 90) -> DataFrame:
    """Last backup per type taken by the agent's service account."""
    accounts = (services.filter(F.col("servicename").contains("Agent"))
                .select("server_name", F.col("service_account").alias("user_name")))
    kind = codes.decode(F.col("type"), codes.BACKUP_TYPES_SHORT, F.col("type"))
    last = (backupset.join(accounts, ["server_name", "user_name"], "left_semi")
            .groupBy(*DB, "user_name", kind.alias("backup_type"))
            .agg(F.max("media_set_id").alias("media_set_id"),
                 F.max("backup_finish_date").alias("backup_finish_date"))
            .filter(F.col("backup_finish_date") > dates.ago(as_of, days, "day")))
    known = (databases.filter("name <> 'tempdb'")
             .select("server_name", F.col("name").alias("database_name")))
    return last.join(media, ["server_name", "media_set_id"]).join(known, DB).select(
        *DB, "user_name", "backup_type", "media_set_id", "backup_finish_date",
        dates.boundary_diff("hour", F.col("backup_finish_date"), dates.instant(as_of)).alias("hours_since"),
        "physical_device_name")


HTML_COLUMNS = ["server_name", "database_name", "backup_start_date", "backup_finish_date",
                "backup_type", "backup_path"]


def backup_history_html(backupset: DataFrame, media: DataFrame, as_of: str | datetime, days: int = 1,
                        databases: list[str] | None = None) -> DataFrame:
    """Mail body of recent full backups, one document per server, as ordered lines.

    Section 1 opens the document, section 2 holds a row per backup and section 3
    closes it. Lines stay rows, so a server with many backups makes many rows
    and not one huge value.
    """
    recent = backupset.filter((F.col("type") == "D") &
                              (F.col("backup_start_date") >= dates.ago(as_of, days, "day")))
    if databases:
        recent = recent.filter(F.col("database_name").isin(*databases))
    rows = recent.join(media, ["server_name", "media_set_id"]).select(
        "server_name", F.lit(2).alias("section"), "database_name", "backup_finish_date", "backup_set_id",
        text.html_row([
            F.col("server_name"), F.col("database_name"),
            dates.style_text(F.col("backup_start_date"), 126),
            dates.style_text(F.col("backup_finish_date"), 126),
            codes.decode(F.col("type"), codes.BACKUP_TYPES), F.col("physical_device_name"),
        ]).alias("html"))
    head = ("<html><body><H3></H3><table border = 1><tr>"
            + "".join(f"<th> {c} </th>" for c in HTML_COLUMNS) + "</tr>")
    frame = (backupset.select("server_name").distinct()
             .withColumn("_part", F.explode(F.array(
                 F.struct(F.lit(1).alias("section"), F.lit(head).alias("html")),
                 F.struct(F.lit(3).alias("section"), F.lit("</table></body></html>").alias("html")))))
             .select("server_name", "_part.section", F.lit(None).cast("string").alias("database_name"),
                     F.lit(None).cast("timestamp_ntz").alias("backup_finish_date"),
                     F.lit(None).cast("long").alias("backup_set_id"), "_part.html"))
    return rows.unionByName(frame)


def _to_back_up(databases: DataFrame) -> DataFrame:
    return (databases.filter("state_desc = 'ONLINE' and name <> 'tempdb' and not is_in_standby")
            .select("server_name", F.col("name").alias("database_name"), "recovery_model_desc",
                    "is_read_only"))


def _finding(databases: DataFrame, finding: str, details: Column) -> DataFrame:
    return databases.select("server_name", F.lit("Backup").alias("findings_group"),
                            F.lit(finding).alias("finding"), details.alias("details"))


def data_backup_findings(databases: DataFrame, backupset: DataFrame, as_of: str | datetime,
                         preferred: DataFrame | None = None) -> DataFrame:
    """Databases without a data backup in the last day, in words.

    ``preferred`` may list databases another replica is preferred for
    (``server_name, database_name``); they are left out.
    """
    wanted = _to_back_up(databases)
    if preferred is not None:
        wanted = changes.delete_matching(wanted, preferred, DB)
    start = F.col("backup_start_date")
    newest_first = F.struct(-F.unix_micros(start.cast("timestamp")), "type")
    last = (backupset.filter("type <> 'L' and not is_snapshot").groupBy(*DB)
            .agg(F.max(start).alias("backup_start_date"), F.min_by("type", newest_first).alias("type")))
    rows = wanted.join(last, DB, "left")
    days = dates.boundary_diff("day", start, dates.instant(as_of))
    age = F.concat(dates.style_text(start, 120), F.lit(" ("), text.plural(days, "day"), F.lit(" ago)"),
                   F.when(F.col("type") == "I", " (differential backup)").otherwise(""))
    name = F.concat(F.lit("Database "), F.col("database_name"))
    details = (F.when(start.isNull(), F.concat(name, F.lit(" never backed up.")))
               .when(start < dates.ago(as_of, 7, "day"),
                     F.concat(name, F.lit(" last backed up over a week ago: "), age))
               .when(start < dates.ago(as_of, 1, "day"), F.concat(name, F.lit(" last backed up: "), age)))
    old = rows.filter(start.isNull() | (start < dates.ago(as_of, 1, "day")))
    return _finding(old, "Backups Not Performed Recently", details)


def log_backup_findings(databases: DataFrame, backupset: DataFrame, as_of: str | datetime,
                        minutes: int = 60) -> DataFrame:
    """Databases that need log backups and have had none lately, in words."""
    wanted = changes.delete_where(
        _to_back_up(databases),
        (F.col("recovery_model_desc") == "SIMPLE") | (F.col("database_name") == "model")
        | F.col("is_read_only"))
    start = F.col("backup_start_date")
    last = (backupset.filter("type = 'L'").groupBy(*DB)
            .agg(F.max("backup_start_date").alias("backup_start_date")))
    name = F.concat(F.lit("Database "), F.col("database_name"))
    age = dates.boundary_diff("minute", start, dates.instant(as_of))
    details = (F.when(start.isNull(), F.concat(name, F.lit(" has never had a log backup.")))
               .otherwise(F.concat(name, F.lit(" had its last log backup on: "),
                                   dates.style_text(start, 120), F.lit(" ("),
                                   text.plural(age, "min"), F.lit(" ago)"))))
    old = wanted.join(last, DB, "left").filter(
        start.isNull() | (start < dates.ago(as_of, minutes, "minute")))
    return _finding(old, "Full Recovery Mode w/o Log Backups", details).distinct()


def backup_state(backupset: DataFrame, databases: DataFrame, as_of: str | datetime,
                 replica_roles: DataFrame | None = None, only_problems: bool = True) -> DataFrame:
    """Board of last backups per database; OK means full or differential within a day."""
    now = dates.instant(as_of)
    taken = backupset.filter(F.col("user_name") != "NT AUTHORITY\\SYSTEM")
    last = pivots.property_bag(taken, DB, "type", "backup_finish_date",
                               {"last_full": "D", "last_differential": "I", "last_log": "L"})
    board = (databases.withColumnRenamed("name", "database_name").join(last, DB, "left")
             .withColumn("hr_since_full", dates.boundary_diff("hour", F.col("last_full"), now))
             .withColumn("hr_since_diff", dates.boundary_diff("hour", F.col("last_differential"), now))
             .withColumn("min_since_log", dates.boundary_diff("minute", F.col("last_log"), now))
             .withColumn("backup_state", F.when((F.col("hr_since_diff") < 24) | (F.col("hr_since_full") < 24),
                                                "OK").otherwise("NO"))
             .filter("database_name <> 'tempdb'"))
    if only_problems:
        board = board.filter("backup_state <> 'OK'")
    if replica_roles is not None:
        board = board.join(replica_roles.select(*DB, F.col("role_desc").alias("ag")), DB, "left")
    else:
        board = board.withColumn("ag", F.lit(None).cast("string"))
    return board.select(
        "ag", *DB, "backup_state", "last_full", "hr_since_full", "last_differential", "hr_since_diff",
        "last_log", "min_since_log", "compatibility_level", "state_desc", "user_access_desc",
        "recovery_model_desc", "log_reuse_wait_desc")


def backup_size_delta(backupset: DataFrame) -> DataFrame:
    """Compressed size of each data backup against the one before it, in GB."""
    sized = _history_rows(backupset).select(
        *DB, "backup_start_date", "backup_set_id",
        numbers.bytes_to_gb(F.col("compressed_backup_size")).alias("compressed_gb"))
    pairs = adjacent.with_previous(sized, DB, ["backup_start_date", "backup_set_id"], ["compressed_gb"],
                                   adjacent.time_bucket("backup_start_date", HOUR))
    return pairs.select(*DB, "backup_start_date", "backup_set_id", "compressed_gb",
                        (F.col("compressed_gb") - F.col("prev_compressed_gb")).alias("size_diff_gb"))


def restore_history(restores: DataFrame, backupset: DataFrame, files: DataFrame,
                    media: DataFrame) -> DataFrame:
    """Restores with decoded type, source device and restored files."""
    sets = backupset.select("server_name", "backup_set_id", "media_set_id")
    return (restores.join(sets, ["server_name", "backup_set_id"])
            .join(media, ["server_name", "media_set_id"])
            .join(files, ["server_name", "restore_history_id"])
            .select("server_name", "restore_history_id",
                    F.col("destination_database_name").alias("database_name"),
                    codes.decode(F.col("restore_type"), codes.RESTORE_TYPES, F.col("restore_type"))
                    .alias("restore_type"),
                    "restore_date", F.col("physical_device_name").alias("source"),
                    F.col("destination_phys_name").alias("restore_file"),
                    F.col("user_name").alias("restored_by")))


def restore_durations(trace: DataFrame, databases: list[str] | None = None) -> DataFrame:
    """Restore events with the time to the next event of the database, in milliseconds."""
    rows = trace.select(*DB, "event_id", "event_class", "event_subclass", "text_data", "start_time")
    if databases:
        rows = rows.filter(F.col("database_name").isin(*databases))
    pairs = adjacent.with_next(rows, DB, ["start_time", "event_id"], ["start_time"],
                               adjacent.time_bucket("start_time"))
    return pairs.filter("event_class = 115 and event_subclass = 2").select(
        *DB, "event_id", "text_data", "start_time",
        dates.boundary_diff("millisecond", F.col("start_time"), F.col("next_start_time"))
        .alias("approximate_restore_ms"))
