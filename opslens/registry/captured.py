"""State reports over captured tables: three captures are written, and the report is asked for the middle one.

The earlier and the later capture hold the same rows in another state, so a report that
read or mixed them would not give the twin's rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from opslens.operators import captures
from opslens.plans import availability, backup, storage, workload
from opslens.registry import availability as ha_registry, backup as backup_registry, storage as storage_registry, workload as workload_registry
from opslens.registry.common import AS_OF, BACKUP_AS_OF, Query
from opslens.session import new_folder
from opslens.sources.sinks import append_snapshot

HOUR = timedelta(hours=1)
NEWEST = datetime.fromisoformat(AS_OF)
SHOWN, ASKED = NEWEST - HOUR, NEWEST - HOUR / 2

#: A changed state: text and numbers that the reports show.
CHANGED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "databases": lambda d: d.withColumn("state_desc", F.lit("RESTORING")),
    "backupset": lambda d: d.withColumn("backup_finish_date", F.col("backup_finish_date") - F.expr("INTERVAL 1 HOUR")),
    "master_files": lambda d: d.withColumn("size", F.col("size") * 2 + 1),
    "volumes": lambda d: d.withColumn("available_bytes", F.floor(F.col("available_bytes") / 2)),
    "database_replica_states": lambda d: d.withColumn("last_commit_time", F.col("last_commit_time") - F.expr("INTERVAL 1 HOUR")),
    "availability_groups": lambda d: d.withColumn("name", F.lower("name")),
    "database_transactions": lambda d: d.withColumn("log_bytes_used", F.col("log_bytes_used") + 1),
    "ring_buffer": lambda d: d.withColumn("ticks", F.col("ticks") + 1000),
    "volume_xml_lines": lambda d: d.withColumn("output", F.replace("output", F.lit("MB"), F.lit("KB"))),
    "sessions": lambda d: d.withColumn("login_name", F.upper("login_name")),
}


def captured(t, names: list[str]) -> captures.State:
    """The bound tables as three captures in the catalog, read as of half an hour after the second."""
    tables = {}
    for name in names:
        table = f"capture_{name}_{uuid4().hex}"
        frame = getattr(t, name)
        path = new_folder(t.spark, table)
        for moment in (SHOWN - HOUR, SHOWN, NEWEST):
            append_snapshot(frame if moment == SHOWN else CHANGED.get(name, lambda d: d)(frame), table, moment, path=path)
        tables[name] = table
    return captures.state_as_of(t.spark, tables, ASKED)


def as_of(names: list[str], report: Callable[[captures.State], DataFrame], base: Query) -> Query:
    """A report over captured tables; its twin is that of the plain report, with the moment."""
    def run(t) -> DataFrame:
        state = captured(t, names)
        return state.stamped(report(state))
    return Query(run, f"SELECT r.*, TIMESTAMP '{SHOWN}' AS captured_at FROM ({base.sql}) r")


OPEN = ["database_transactions", "session_transactions", "sessions", "connections", "active_requests", "query_texts"]
REPLICAS = ["database_replica_states", "cluster_databases", "availability_groups", "availability_replicas"]

QUERIES = {
    "backup_state_as_of": as_of(["backupset", "databases"], lambda s: backup.backup_state(s["backupset"], s["databases"], BACKUP_AS_OF),
                                backup_registry.QUERIES["backup_state"]),
    "disk_space_as_of": as_of(["master_files", "volumes"], lambda s: storage.disk_space(s["master_files"], s["volumes"]), storage_registry.QUERIES["disk_space"]),
    "size_share_as_of": as_of(["master_files"], lambda s: storage.size_share(s["master_files"]), storage_registry.QUERIES["size_share"]),
    "volumes_from_xml_as_of": as_of(["volume_xml_lines"], lambda s: storage.volumes_from_xml(s["volume_xml_lines"]), storage_registry.QUERIES["volumes_from_xml"]),
    "replica_status_as_of": as_of(REPLICAS, lambda s: availability.replica_status(*[s[n] for n in REPLICAS], AS_OF), ha_registry.QUERIES["replica_status"]),
    "open_transactions_as_of": as_of(OPEN, lambda s: workload.open_transactions(*[s[n] for n in OPEN], AS_OF), workload_registry.QUERIES["open_transactions"]),
    "cpu_history_as_of": as_of(["ring_buffer", "sys_info"], lambda s: workload.cpu_history(s["ring_buffer"], s["sys_info"], AS_OF),
                               workload_registry.QUERIES["cpu_history"]),
}
