"""Space, growth and file reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions import codes, dates, numbers, text, xmls
from opslens.operators import ranking, textagg

SYSTEM_DATABASES = ["master", "model", "msdb", "tempdb"]

# Growth settings the fix texts ask for.
POLICY_GROWTH = {"log": "256MB", "data": "512GB", "tempdb_log": "512MB", "tempdb_data": "1024GB"}
REPORT_GROWTH = {"log": "256MB", "data": "512MB", "tempdb_log": "512MB", "tempdb_data": "1024MB"}

# Folders the orphan search leaves out, as LIKE patterns with ~ as escape.
ORPHAN_EXCLUDED = [
    "%:\\$RECYCLE_BIN\\%",
    "%:\\Program Files\\Microsoft SQL Server%",
    "%:\\SW_DVD9_SQL_Svr_Enterprise_Edtn_2008_R2_English_MLF_X16-29540%",
]

LADDER_STEPS = 15
LADDER_STEP_KB = 2 * 1024 * 1024


def volumes_from_xml(lines: DataFrame) -> DataFrame:
    """Volumes from the XML a server printed line by line.

    The lines of one server are one short document (a node per volume).
    """
    document = textagg.ordered_text(F.col("output"), F.col("line"), "")
    parsed = lines.groupBy("server_name").agg(document.alias("xml")).select(
        "server_name", F.posexplode(xmls.parse(F.col("xml"), xmls.PROPERTY_BAG)["Object"]))

    def prop(name: str) -> Column:
        hit = F.filter(F.col("col")["Property"], lambda p: p["_Name"] == name)
        return F.get(hit, F.lit(0))["_VALUE"]

    return parsed.select(
        "server_name", F.col("pos").cast("long").alias("object_no"),
        F.coalesce(prop("Name"), F.lit("")).alias("volume"),
        prop("freeSpaceMB").cast("decimal(15,3)").alias("free_space_mb"),
        prop("capacityMB").cast("decimal(15,3)").alias("capacity_mb"))


def _with_volume(files: DataFrame, volumes: DataFrame, target: float) -> DataFrame:
    """Files with the size, free share and missing GB of their volume."""
    total, free = F.col("total_bytes"), F.col("available_bytes")
    sized = volumes.select(
        "server_name", "volume_id", "logical_volume_name", F.col("mount_point").alias("drive"),
        numbers.whole_gb(total).alias("drive_size_gb"), numbers.whole_gb(free).alias("drive_free_gb"),
        numbers.decimal(F.try_divide(free.cast("double"), total.cast("double")) * 100, 20, 2).alias("disk_free_percent"))
    add = numbers.decimal(
        numbers.target_free_add(F.col("drive_size_gb"), F.col("drive_free_gb"), target), 20, 2)
    sized = sized.withColumn("target_add_gb", add).withColumn(
        "drive_target_gb", F.col("drive_free_gb") + F.col("target_add_gb"))
    return files.join(sized, ["server_name", "volume_id"])


def disk_space(files: DataFrame, volumes: DataFrame, target: float = 15) -> DataFrame:
    """File sizes beside the free space of their volume and the GB to add for a target."""
    user_files = files.filter(~F.col("database_name").isin(*SYSTEM_DATABASES))
    return _with_volume(user_files, volumes, target).select(
        "server_name", "database_name", "physical_name",
        (F.col("size") * 8 / 1048576.0).alias("size_gb"), "type_desc", "logical_volume_name", "drive",
        "drive_size_gb", "drive_free_gb", "disk_free_percent", "target_add_gb",
        F.col("drive_target_gb").alias("total_target_gb")).distinct()


def _shrink_text(database: Column, file: Column, free_mb: Column, percent: int) -> Column:
    reclaim = F.floor(free_mb * percent / 100).cast("long").cast("string")
    return F.concat(F.lit("USE ["), database, F.lit("]\r\nDBCC SHRINKFILE (N'"), file, F.lit("' , "),
                    reclaim, F.lit(");\r\n\r\n"))


def _free_percent(free_mb: Column, size_mb: Column) -> Column:
    return numbers.exact_div(free_mb * 10000, size_mb * 100, 2)


def log_space(files: DataFrame, databases: DataFrame, percent: int = 50) -> DataFrame:
    """Log size, use and free space per database, with shrink text where the log can shrink."""
    db = ["server_name", "database_name"]
    logs = files.filter("type = 1")
    size, used = F.sum("size"), F.sum("used_pages")
    space = logs.groupBy(*db).agg(
        numbers.pages_to_mb(size).alias("log_file_size_mb"),
        numbers.pages_to_mb(used).alias("log_space_used_mb"),
        numbers.pages_to_mb(size - used).alias("log_free_space_mb"))
    known = databases.filter("database_id > 4").select(
        "server_name", F.col("name").alias("database_name"), "database_id", "log_reuse_wait_desc")
    log_files = logs.select("server_name", "database_id", F.col("name").alias("file_name"))
    rows = space.join(known, db).join(log_files, ["server_name", "database_id"], "left")
    free = F.col("log_free_space_mb")
    return rows.select(
        *db, "file_name", "log_file_size_mb", "log_space_used_mb", "log_free_space_mb",
        _free_percent(free, F.col("log_file_size_mb")).alias("free_percent"), "log_reuse_wait_desc",
        F.when(F.col("log_reuse_wait_desc") == "NOTHING",
               _shrink_text(F.col("database_name"), F.col("file_name"), free, percent)).alias("shrink_text"))


def growth_events(trace: DataFrame, as_of: str | datetime, days: int = 1) -> DataFrame:
    """Last automatic growth per file and kind."""
    recent = trace.filter(F.col("event_class").isin(*codes.GROWTH_KIND)
                          & (F.col("start_time") > dates.ago(as_of, days, "day")))
    return recent.groupBy("server_name", "database_name", "file_name",
                          codes.decode(F.col("event_class"), codes.GROWTH_KIND).alias("kind")).agg(
        F.max("start_time").alias("last_start"), F.max("end_time").alias("last_end"))


def growth_text(growth: Column, is_percent: Column) -> Column:
    return F.when(is_percent, F.concat(growth.cast("string"), F.lit("%"))).otherwise(
        F.concat(numbers.int_div(growth, 128).cast("string"), F.lit(" MB")))


def _growth_fix(start: str, end: str, growth: dict[str, str], data_kinds: list[str],
                tempdb_end: str) -> Column:
    """Text that sets a fixed growth, by file extension; other extensions are an error."""
    extension = text.extension_of(F.col("physical_name"))
    is_tempdb = F.lower("database_name") == "tempdb"

    def fix(size: str, tail: str) -> Column:
        return F.concat(F.lit(start + "ALTER DATABASE ["), F.col("database_name"),
                        F.lit("] MODIFY FILE (NAME = ["), F.col("name"),
                        F.lit("], FILEGROWTH = " + size + tail))

    is_data = extension.isin(*data_kinds)
    return (F.when((extension == "ldf") & ~is_tempdb, fix(growth["log"], end))
            .when(is_data & ~is_tempdb, fix(growth["data"], end))
            .when((extension == "ldf") & is_tempdb, fix(growth["tempdb_log"], tempdb_end))
            .when(is_data & is_tempdb, fix(growth["tempdb_data"], tempdb_end))
            .otherwise("Error - Invalid Option"))


def file_report(files: DataFrame, volumes: DataFrame, databases: DataFrame,
                growths: DataFrame | None = None, target: float = 15, percent: int = 50) -> DataFrame:
    """Everything about a file: space in file and volume, growth, last growths, fix texts.

    ``growths`` is the result of :func:`growth_events`; without it the growth
    times are null.
    """
    known = databases.select("server_name", "database_id", "log_reuse_wait_desc")
    rows = (_with_volume(files, volumes, target)
            .filter(~F.lower("database_name").isin(*SYSTEM_DATABASES))
            .join(known, ["server_name", "database_id"]))
    times = [f"{k}_growth_{e}" for k in ("rows", "log") for e in ("start", "end")]
    if growths is None:
        for column in times:
            rows = rows.withColumn(column, F.lit(None).cast("timestamp_ntz"))
    else:
        key = ["server_name", "database_name", "file_name"]
        last = growths.groupBy(*key).agg(*[
            F.max(F.when(F.col("kind") == k.upper(), F.col(f"last_{e}"))).alias(f"{k}_growth_{e}")
            for k in ("rows", "log") for e in ("start", "end")])
        rows = rows.join(last.withColumnRenamed("file_name", "name"),
                         ["server_name", "database_name", "name"], "left")

    size, used = F.col("size"), F.col("used_pages")

    def stats(kind: str, code: int) -> list[Column]:
        mine = F.col("type") == code
        size_mb, free_mb = numbers.pages_to_mb(size), numbers.pages_to_mb(size - used)
        return [F.when(mine, size_mb).alias(f"{kind}_file_size_mb"),
                F.when(mine, numbers.pages_to_mb(used)).alias(f"{kind}_space_used_mb"),
                F.when(mine, free_mb).alias(f"{kind}_free_space_mb"),
                F.when(mine, _free_percent(free_mb, size_mb)).alias(f"{kind}_free_percent"),
                F.col(f"{kind}_growth_start"), F.col(f"{kind}_growth_end")]

    log_free = F.when(F.col("type") == 1, numbers.pages_to_mb(size - used))
    max_size = F.when(F.col("max_size") == -1, "UNLIMITED").otherwise(
        F.concat(numbers.int_div(F.col("max_size") * 8, 1024).cast("string"), F.lit(" MB")))
    return rows.select(
        "server_name", "database_name", F.col("name").alias("file_name"), "physical_name",
        numbers.decimal(numbers.int_div(size * 8, 1024), 20, 2).alias("size_mb"), "type_desc",
        "logical_volume_name", "drive", "drive_size_gb", "drive_free_gb", "disk_free_percent",
        "target_add_gb", "drive_target_gb", *stats("rows", 0), *stats("log", 1), "log_reuse_wait_desc",
        F.when(F.col("is_percent_growth"), "Yes").otherwise("No").alias("is_percent_growth"),
        growth_text(F.col("growth"), F.col("is_percent_growth")).alias("growth_in_increment_of"),
        numbers.next_growth_mb(size, F.col("growth"), F.col("is_percent_growth")).alias("next_auto_growth_size_mb"),
        max_size.alias("max_size"),
        F.when(F.lower("log_reuse_wait_desc") == "nothing",
               _shrink_text(F.col("database_name"), F.col("name"), log_free, percent)).alias("shrink_text"),
        _growth_fix("USE [master]; ", ", MAXSIZE = UNLIMITED);", REPORT_GROWTH, ["mdf", "ndf"], ");")
        .alias("change_autogrow"))


def growth_policy(files: DataFrame) -> DataFrame:
    """Files whose growth is the 10 % or 1 MB default, or above 64 MB, with the fix text."""
    shown = growth_text(F.col("growth"), F.col("is_percent_growth"))
    out = files.filter(shown.isin("10%", "1 MB")
                       | (~F.col("is_percent_growth") & (numbers.int_div(F.col("growth"), 128) > 64)))
    max_size = (F.when(F.col("max_size") == 0, "No growth is allowed")
                .when(F.col("max_size") == -1, "File will grow until the disk is full")
                .otherwise(F.col("max_size").cast("string")))
    return out.select(
        "server_name", _growth_fix("", ");", POLICY_GROWTH, ["mdf"], ");").alias("change_autogrow"),
        "database_name", F.col("name").alias("logical_name"),
        numbers.pages_to_mb(F.col("size")).alias("file_size_mb"),
        F.when(F.col("is_percent_growth"), "Yes").otherwise("No").alias("is_percent_growth"),
        shown.alias("growth_in_increment_of"),
        numbers.next_growth_mb(F.col("size"), F.col("growth"), F.col("is_percent_growth")).alias("next_auto_growth_size_mb"),
        max_size.alias("max_size"), "physical_name")


def growth_settings(files: DataFrame) -> DataFrame:
    """Size, limit and growth of each file as text."""
    def kb(c: str) -> Column:
        return F.concat((F.col(c) * 8).cast("string"), F.lit(" KB"))

    return files.select(
        "server_name", "database_name", F.col("name").alias("file_name"), "file_id", kb("size").alias("size"),
        F.when(F.col("max_size") == -1, "Unlimited").otherwise(kb("max_size")).alias("max_size"),
        F.when(F.col("is_percent_growth"), F.concat(F.col("growth").cast("string"), F.lit("%")))
        .otherwise(kb("growth")).alias("growth"), "type_desc")


def size_share(files: DataFrame) -> DataFrame:
    """Share of each database in its server's total, with a bar.

    Totals come from the sizes per database, so each step ships partial sums.
    """
    per_db = files.groupBy("server_name", "database_name").agg(F.sum("size").alias("pages"))
    total = per_db.groupBy("server_name").agg(F.sum("pages").alias("total_pages"))
    share = numbers.exact_div(F.col("pages"), F.col("total_pages"), 2)
    return per_db.join(total, "server_name").select(
        "server_name", "database_name",
        numbers.exact_div(F.col("pages") * 8, 1024 * 1024, 2).alias("total_size_gb"),
        numbers.exact_div(F.col("pages") * 100, F.col("total_pages"), 4).alias("percent_size"),
        text.bar(share * 100).alias("graph"))


def orphaned_files(inventory: DataFrame, files: DataFrame, as_of: str | datetime,
                   excluded_drives: list[str] | None = None,
                   excluded_paths: list[str] | None = None) -> DataFrame:
    """Database files on disk that no database knows, with delete text and age."""
    path = F.col("path")
    found = inventory.filter(text.extension_of(path).isin("mdf", "ndf", "ldf"))
    for drive in ["C"] if excluded_drives is None else excluded_drives:
        found = found.filter(F.upper(F.substring(path, 1, 1)) != drive.upper())
    for pattern in ORPHAN_EXCLUDED if excluded_paths is None else excluded_paths:
        found = found.filter(~F.like(path, F.lit(pattern), F.lit("~")))
    known = files.select("server_name", F.lower("physical_name").alias("_path"))
    return (found.withColumn("_path", F.lower(path)).join(known, ["server_name", "_path"], "left_anti")
            .select("server_name", F.concat(F.lit("Del "), path).alias("delete_text"), "path", "modified",
                    numbers.int_div(F.col("length"), numbers.MB).alias("size_mb"),
                    dates.boundary_diff("day", F.col("modified"), dates.instant(as_of)).alias("days_old")))


def log_reuse_waits(databases: DataFrame) -> DataFrame:
    """Databases whose log waits for something before it can be reused."""
    return databases.filter("log_reuse_wait_desc <> 'NOTHING'").select(
        "server_name", "name", "log_reuse_wait_desc")


def shrink_candidates(databases: DataFrame, files: DataFrame) -> DataFrame:
    """Truncating shrink text for log files that wait for nothing."""
    free = (databases.filter("database_id > 4 and log_reuse_wait_desc = 'NOTHING'")
            .select("server_name", "database_id", F.col("name").alias("database")))
    command = F.concat(F.lit("USE ["), F.col("database"), F.lit("]\r\nDBCC SHRINKFILE (N'"), F.col("name"),
                       F.lit("' , 0, TRUNCATEONLY)\r\n\r\n"))
    return files.filter("type_desc = 'LOG'").join(free, ["server_name", "database_id"]).select(
        "server_name", F.col("database").alias("database_name"), command.alias("shrink_text"))


def growth_ladder(files: DataFrame) -> DataFrame:
    """Text of 15 size steps of 2 GB for each data file."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(LADDER_STEPS)))
    rows = files.filter("type_desc = 'ROWS'").select(
        "server_name", "database_name", "name", "size", steps.alias("step"))
    size_kb = F.col("size") * 8 + F.col("step").cast("long") * LADDER_STEP_KB
    command = F.concat(F.lit("ALTER DATABASE ["), F.col("database_name"), F.lit("] MODIFY FILE ( NAME = N'"),
                       F.col("name"), F.lit("', SIZE = "), size_kb.cast("string"), F.lit("KB )"))
    return rows.select("server_name", "database_name", F.col("name").alias("file_name"), "step",
                       command.alias("grow_text"))


def _of_extension(inventory: DataFrame, extension: str | None) -> DataFrame:
    return inventory.filter(text.extension_of(F.col("path")) == extension) if extension else inventory


def old_files(inventory: DataFrame, as_of: str | datetime, days: int = 180,
              extension: str | None = None) -> DataFrame:
    """Files older than some days with their size in GB."""
    old = _of_extension(inventory, extension).filter(F.col("modified") < dates.ago(as_of, days, "day"))
    return old.select("server_name", "path", "modified",
                      F.round(F.col("length") / numbers.GB, 2).alias("size_gb"))


def largest_files(inventory: DataFrame, as_of: str | datetime, min_bytes: int = numbers.MB, days: int = 7,
                  limit: int = 500, extension: str | None = "bak") -> DataFrame:
    """Largest old files of a kind."""
    old = _of_extension(inventory, extension).filter(
        (F.col("length") > min_bytes) & (F.col("modified") < dates.ago(as_of, days, "day")))
    top = ranking.top_rows(old, "length", ["server_name", "path"], limit)
    return top.select("server_name", "path", "modified", (F.col("length") / numbers.GB).alias("size_gb"),
                      text.directory_of(F.col("path")).alias("directory"))


def retention_candidates(inventory: DataFrame, as_of: str | datetime, extension: str = "trn",
                         days: int = 4) -> DataFrame:
    """Files of a kind past their retention, with the cut-off; nothing is deleted."""
    cutoff = dates.ago(as_of, days, "day")
    return _of_extension(inventory, extension).filter(F.col("modified") < cutoff).select(
        "server_name", "path", "modified", "length", dates.style_text(cutoff, 126).alias("cutoff"))


def empty_directories(directories: DataFrame, inventory: DataFrame) -> DataFrame:
    """Directories that hold no file."""
    used = inventory.select("server_name", text.directory_of(F.col("path")).alias("directory")).distinct()
    return directories.select("server_name", "directory").join(used, ["server_name", "directory"], "left_anti")


def volume_sizes(volumes: DataFrame) -> DataFrame:
    return volumes.select("server_name", "mount_point",
                          F.round(F.col("total_bytes") / numbers.GB, 2).alias("size_gb"),
                          F.round(F.col("available_bytes") / numbers.GB, 2).alias("free_gb"))


def file_locations(inventory: DataFrame, extensions: list[str]) -> DataFrame:
    """Paths of files by extension."""
    return inventory.filter(text.extension_of(F.col("path")).isin(*extensions)).select("server_name", "path")


def database_file_locations(files: DataFrame) -> DataFrame:
    """Where the files of every database but the temporary one are."""
    return files.filter("database_id <> 2").select("server_name", "name", F.col("physical_name").alias("current_file_location"))


def file_modified(inventory: DataFrame, paths: list[str]) -> DataFrame:
    """Modification time of given files."""
    return inventory.filter(F.col("path").isin(*paths)).select("server_name", "path", "modified")

