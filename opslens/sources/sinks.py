"""Writers: CSV, logs, XML rows, snapshots with retention."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from hashlib import md5

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from opslens.functions import dates
from opslens.operators.captures import CAPTURE, LISTED, PARTS, lists_folder
from opslens.session import cut_lineage, new_folder, scratch


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_log(df: DataFrame, path: str, batch: str | int, facts: dict[str, Column] | None = None) -> bool:
    """Rows added to a log, exactly once per ``batch``: a name the caller gives its rows, the same when it tries again.

    A batch owns one folder. Its rows are written first and published after that by a row in
    the ledger beside them; ``read_log`` shows published batches only. So a writer that dies
    in between leaves nothing to see, its second try replaces what it left, and a batch that
    is published already is left alone. ``facts`` are aggregates over the rows that the ledger
    keeps. Returns whether the rows were added.
    """
    spark = df.sparkSession
    entry = f"{path}/ledger/batch={batch}"
    if _exists(spark, f"{entry}/_SUCCESS"):  # written last
        return False
    seen = Observation()
    found = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[value.alias(name) for name, value in (facts or {}).items()])
    found.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    kinds = df.agg(F.count(F.lit(1)).alias("rows"), *[value.alias(name) for name, value in (facts or {}).items()]).schema
    spark.createDataFrame([tuple(seen.get[k] for k in kinds.names)], kinds).coalesce(1).write.mode("overwrite").parquet(entry)
    return True


def _located(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, whatever that is."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _exists(spark: SparkSession, path: str) -> bool:
    system, found = _located(spark, path)
    return system.exists(found)


def _values(spark: SparkSession, path: str) -> list[str]:
    """The values that the partition folders below a path stand for."""
    system, found = _located(spark, path)
    names = [entry.getPath().getName() for entry in system.listStatus(found)] if system.exists(found) else []
    return sorted(name.split("=", 1)[1] for name in names if "=" in name)


def _delete(spark: SparkSession, path: str) -> None:
    system, found = _located(spark, path)
    system.delete(found, True)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """(batch, rows, facts...) of the published batches of a log; None if there is none."""
    if not _exists(spark, f"{path}/ledger"):
        return None
    try:
        return spark.read.parquet(f"{path}/ledger")
    except AnalysisException:  # the first entry was not finished
        return None


def read_log(spark: SparkSession, path: str, schema: T.StructType | None = None, batch_type: str = "string") -> DataFrame:
    """Published rows of a log with their ``batch``; unpublished folders are pruned by the join on the partition column."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    ledger = read_ledger(spark, path)
    if ledger is None:
        return spark.createDataFrame([], T.StructType([*(schema.fields if schema else []), T.StructField("batch", T.StringType())])).withColumn(
            "batch", F.col("batch").cast(batch_type))
    published = ledger.select(F.col("batch").cast("string"))
    return reader.parquet(f"{path}/rows").withColumn("batch", F.col("batch").cast("string")).join(published, "batch", "left_semi").withColumn(
        "batch", F.col("batch").cast(batch_type))


def to_xml_rows(df: DataFrame, row_tag: str = "Transaction") -> DataFrame:
    """One XML document per row."""
    return df.withColumn("xml", F.to_xml(F.struct(*df.columns), {"rowTag": row_tag}))


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Result kept for reuse: as a table at ``path``, else as a reliable checkpoint."""
    if path is None:
        return cut_lineage(df)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_table(df: DataFrame, purpose: str) -> DataFrame:
    """Result written below the shared folder and read back."""
    return materialize(df, new_folder(df.sparkSession, purpose))


def scalar(df: DataFrame):
    """First column of the first row."""
    row = df.select(df.columns[0]).first()
    return None if row is None else row[0]


def append_snapshot(df: DataFrame, table: str, captured_at: str | datetime, retention_days: int = 14,
                    servers: list[str] | None = None, path: str | None = None) -> list[str]:
    """Snapshot added to a table partitioned by day, capture and set of servers; days past their retention are dropped.

    Returns the dropped days. The servers of a call share one partition, so a fleet takes a few
    files and not one per server; their names, which come to the driver, are listed beside the
    rows when these are written. The same servers captured again for the same moment replace
    what they wrote, and nothing else, so a retry leaves the table as it was: the same set
    overwrites its partition, and other sets that hold some of the servers are rewritten without
    them. (A writer that dies before that leaves both, until it tries again.) ``servers`` are the
    servers that answered: one without rows is listed, so that it is known to have been empty.
    A new table is kept at ``path``, if one is given. ``df`` is read twice.
    """
    spark = df.sparkSession
    moment = datetime.fromisoformat(str(captured_at))
    names = [r[0] for r in df.select("server_name").distinct().collect()] if "server_name" in df.columns else []
    listed = sorted({*names, *(servers or [])}, key=lambda s: (s is None, s or ""))
    own = md5(json.dumps(listed).encode(), usedforsecurity=False).hexdigest()
    stamped = df.withColumn("captured_at", dates.instant(captured_at)).withColumn(
        "captured_date", F.col("captured_at").cast("date")).withColumn("capture", F.date_format("captured_at", CAPTURE)).withColumn(
        "server_set", F.lit(own))
    if spark.catalog.tableExists(table):
        _overwrite_partitions(stamped, table)
    else:
        writer = stamped.write.format("parquet").partitionBy(*PARTS)
        (writer.option("path", path) if path else writer).saveAsTable(table)
    capture = f"{lists_folder(spark, table)}/captured_date={moment:%Y-%m-%d}/capture={moment:%Y%m%dT%H%M%S.%f}"
    filled = set(names)
    spark.createDataFrame([(s, s in filled) for s in listed], LISTED).coalesce(1).write.mode("overwrite").parquet(f"{capture}/server_set={own}")
    if names and _values(spark, capture) != [own]:
        _take_out(spark, table, capture, own, moment, names)
    return drop_old_days(spark, table, captured_at, retention_days)


def _overwrite_partitions(rows: DataFrame, table: str) -> None:
    """Puts rows into a table in place of what their partitions held."""
    spark = rows.sparkSession
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")  # an insert into a table takes it from the session only
    try:
        rows.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def _take_out(spark: SparkSession, table: str, capture: str, own: str, moment: datetime, names: list[str]) -> None:
    """Takes the rows of some servers out of the other sets of their capture."""
    gone = spark.createDataFrame([(s,) for s in names], "gone string")
    same = F.col("server_name").eqNullSafe(F.col("gone"))
    lists = spark.read.schema(f"{LISTED}, server_set string").parquet(capture).filter(F.col("server_set") != own)
    held = lists.filter("filled").join(gone, same, "left_semi").select("server_set").distinct().collect()
    for (name,) in held:
        spec = {"captured_date": f"{moment:%Y-%m-%d}", "capture": f"{moment:%Y%m%dT%H%M%S.%f}", "server_set": name}
        rest = scratch(lists.filter(F.col("server_set") == name).join(gone, same, "left_anti").drop("server_set"), "servers")
        rows = spark.table(table).filter((F.col("captured_date") == F.lit(spec["captured_date"]).cast("date"))
                                         & (F.col("capture") == spec["capture"]) & (F.col("server_set") == name))
        if rest.filter("filled").isEmpty():
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {_partition(spec)}")
        else:
            _overwrite_partitions(scratch(rows.join(gone, same, "left_anti"), "rows"), table)
        if rest.isEmpty():
            _delete(spark, f"{capture}/server_set={name}")
        else:
            rest.coalesce(1).write.mode("overwrite").parquet(f"{capture}/server_set={name}")


def _partition(spec: dict[str, str]) -> str:
    return "PARTITION (" + ", ".join(f"{k} = '{v}'" for k, v in spec.items()) + ")"


def drop_old_days(spark: SparkSession, table: str, as_of: str | datetime, retention_days: int) -> list[str]:
    """Drops daily partitions older than the retention, their lists first; the list of days is short."""
    today = datetime.fromisoformat(str(as_of)).date()
    oldest = today - timedelta(days=retention_days)
    lists = lists_folder(spark, table)
    listed = [day for day in _values(spark, lists) if date.fromisoformat(day) < oldest]
    for day in listed:
        _delete(spark, f"{lists}/captured_date={day}")
    found = [dict(part.split("=", 1) for part in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    gone = [spec for spec in found if date.fromisoformat(spec["captured_date"]) < oldest]
    for start in range(0, len(gone), 500):
        specs = ", ".join(_partition(spec) for spec in gone[start:start + 500])
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    return sorted({*listed, *(spec["captured_date"] for spec in gone)})
