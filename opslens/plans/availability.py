"""Availability group, seeding, endpoint and connection reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions import codes, dates, numbers, text, xmls
from opslens.operators import adjacent
from opslens.plans.logs import parse_events

SESSION = ["server_name", "session_id"]


# -- connections --------------------------------------------------------------------------------

def connection_endpoints(connections: DataFrame, sessions: DataFrame, listener_ips: DataFrame,
                         listeners: DataFrame, default_port: int = 1433) -> DataFrame:
    """Connections with the listener they came through, else the server's own address."""
    via = listener_ips.join(listeners, ["server_name", "listener_id"], "left").select(
        "server_name", F.col("ip_address").alias("local_net_address"), F.col("ip_address").alias("_ip"),
        F.col("dns_name").alias("_dns"), F.col("port").alias("_port"))
    people = sessions.select(*SESSION, "login_name", "program_name", "database_name")
    return (connections.join(people, SESSION).join(via, ["server_name", "local_net_address"], "left").select(
        *SESSION, "login_name", "program_name", "database_name", "net_transport", "client_net_address",
        "local_net_address", "client_tcp_port", F.coalesce("_dns", "server_name").alias("dns_name"),
        F.when(F.col("net_transport") != "Shared Memory", F.coalesce("_ip", "local_net_address")).alias("ip_address"),
        F.coalesce("_port", F.lit(default_port)).alias("port"), "encrypt_option", "auth_scheme"))


def connection_counts(endpoints: DataFrame) -> DataFrame:
    keys = ["server_name", "database_name", "login_name", "program_name", "client_net_address",
            "local_net_address", "dns_name"]
    return endpoints.groupBy(*keys).agg(F.count("*").alias("cnt"))


def connections_union(connections: DataFrame, sessions: DataFrame, listener_ips: DataFrame,
                      listeners: DataFrame, registry: DataFrame) -> DataFrame:
    """Connections through a listener, and those to an address in the server's registry."""
    people = sessions.select(*SESSION, "login_name", "program_name", "database_name")
    rows = connections.join(people, SESSION)
    shown = [*SESSION, "login_name", "program_name", "database_name", "client_net_address", "client_tcp_port",
             "dns_name", "ip_address", "port", "encrypt_option"]
    by_listener = listeners.join(listener_ips, ["server_name", "listener_id"]).withColumn(
        "local_net_address", F.col("ip_address"))
    through = rows.join(by_listener, ["server_name", "local_net_address"]).select(*shown)
    addresses = registry.filter("value_name = 'IpAddress'").select(
        "server_name", F.col("value_data").alias("local_net_address"), F.col("value_data").alias("ip_address"))
    direct = (rows.join(addresses, ["server_name", "local_net_address"])
              .withColumn("dns_name", F.col("server_name")).withColumn("port", F.col("local_tcp_port")).select(*shown))
    return through.unionByName(direct)


# -- health events ------------------------------------------------------------------------------

def _recent(xe: DataFrame, name: str | None, as_of: str | datetime, hours: int, utc_offset: int) -> DataFrame:
    """Parsed events of a kind in the last hours, with local time.

    The bound is moved to the time of the events, so that older days are not read (an event
    is captured on its day or later) and older documents are not parsed.
    """
    bound = dates.shift_hours(dates.ago(as_of, hours, "hour"), -utc_offset)
    if "captured_date" in xe.columns:
        xe = xe.filter(F.col("captured_date") >= bound.cast("date"))
    if "event_xml" in xe.columns:  # a reader may have parsed them already
        xe = xe.filter(xmls.maybe_since(F.col("event_xml"), bound))
    rows = parse_events(xe, name=name)
    return rows.filter(F.col("event_time") >= bound).withColumn("timestamp", dates.shift_hours(F.col("event_time"), utc_offset))


def _value(position: int) -> Column:
    return xmls.nth(F.col("event"), "value", position)


def _text(position: int) -> Column:
    return xmls.nth(F.col("event"), "text", position)


def _ddl(xe: DataFrame, as_of, hours: int, utc_offset: int, failovers: bool) -> DataFrame:
    is_failover = F.upper(_value(3)).like("%FAILOVER%")  # anywhere in the statement
    rows = _recent(xe, "alwayson_ddl_executed", as_of, hours, utc_offset)
    return rows.filter(is_failover if failovers else ~is_failover).select(
        "server_name", "timestamp", _text(1).alias("ddl_action"), _text(2).alias("ddl_phase"),
        _value(5).alias("ag_name"), text.one_line(_value(3), "").alias("ddl_statement"))


def ha_ddl_events(xe: DataFrame, as_of: str | datetime, hours: int = 24, utc_offset: int = 0) -> DataFrame:
    """Definition changes that are not failovers."""
    return _ddl(xe, as_of, hours, utc_offset, failovers=False)


def ha_failovers(xe: DataFrame, as_of: str | datetime, hours: int = 24, utc_offset: int = 0) -> DataFrame:
    return _ddl(xe, as_of, hours, utc_offset, failovers=True)


def ha_manager_states(xe: DataFrame, as_of: str | datetime, hours: int = 24, utc_offset: int = 0) -> DataFrame:
    return _recent(xe, "availability_replica_manager_state_change", as_of, hours, utc_offset).select(
        "server_name", "timestamp", _text(1).alias("current_state"))


def ha_replica_states(xe: DataFrame, as_of: str | datetime, hours: int = 24, utc_offset: int = 0) -> DataFrame:
    return _recent(xe, "availability_replica_state_change", as_of, hours, utc_offset).select(
        "server_name", "timestamp", _value(4).alias("ag_name"), _text(1).alias("previous_state"),
        _text(2).alias("current_state"))


def ha_lease_expirations(xe: DataFrame, as_of: str | datetime, hours: int = 24, utc_offset: int = 0) -> DataFrame:
    return _recent(xe, "availability_group_lease_expired", as_of, hours, utc_offset).select(
        "server_name", "timestamp", _value(2).alias("ag_name"), _value(1).alias("ag_id"))


def ha_errors(xe: DataFrame, as_of: str | datetime, hours: int = 24, utc_offset: int = 0) -> DataFrame:
    return _recent(xe, "error_reported", as_of, hours, utc_offset).select(
        "server_name", "timestamp", _value(1).cast("long").alias("error_number"),
        _value(2).cast("long").alias("severity"), _value(3).cast("long").alias("state"),
        _value(4).alias("user_defined"), _text(5).alias("category"), _text(6).alias("destination_log"),
        _value(7).alias("is_intercepted"), _value(8).alias("error_message"))


def error_summary(errors: DataFrame, messages: DataFrame, language: int = 1033) -> DataFrame:
    """Errors per number with first and last time and a short message."""
    counted = errors.groupBy("server_name", "error_number").agg(
        F.count("error_number").alias("error_count"), F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"))
    templates = messages.filter(F.col("language_id") == language).select(
        F.col("message_id").cast("long").alias("error_number"), F.col("text").alias("_text"))
    short = codes.decode(F.col("error_number"), codes.HA_ERRORS, F.col("_text"))
    return counted.join(templates, "error_number", "left").select(
        "server_name", "error_number", "error_count", dates.style_text(F.col("_first"), 121).alias("first_date"),
        dates.style_text(F.col("_last"), 121).alias("last_date"),
        short.alias("abbreviated_message"))


def ha_events_named(xe: DataFrame, as_of: str | datetime, hours: int = 24, utc_offset: int = 0) -> DataFrame:
    """All health events with their values by attribute name."""
    event = F.col("event")
    names = ["error_number", "previous_state", "current_state", "availability_group_name",
             "availability_replica_name", "message"]
    return _recent(xe, None, as_of, hours, utc_offset).select(
        "server_name", F.col("event_name").alias("object_name"), "timestamp",
        *[xmls.named_all(event, n).alias(n) for n in names])


# -- seeding, replicas, endpoints ---------------------------------------------------------------

def seeding_history(seeding: DataFrame, cluster_databases: DataFrame, groups: DataFrame) -> DataFrame:
    databases = cluster_databases.select("server_name", F.col("group_database_id").alias("ag_db_id"), "database_name")
    named = groups.select("server_name", F.col("group_id").alias("ag_id"), F.col("name").alias("ag_name"))
    return seeding.join(databases, ["server_name", "ag_db_id"]).join(named, ["server_name", "ag_id"]).select(
        "server_name", "start_time", "completion_time", "ag_name", "database_name", "current_state",
        "performed_seeding", "failure_state", "failure_state_desc")


def seeding_rates(physical_seeding: DataFrame) -> DataFrame:
    """Seeding in MB a second, MB and TB, truncated like the counters."""
    mb = numbers.MB
    return physical_seeding.select(
        "server_name", "local_database_name", "remote_machine_name", "role_desc", "internal_state_desc",
        numbers.int_div(F.col("transfer_rate_bytes_per_second"), mb).alias("transfer_rate_mb_per_second"),
        numbers.int_div(F.col("transferred_size_bytes"), mb).alias("transferred_size_mb"),
        numbers.int_div(F.col("database_size_bytes"), mb * mb).alias("database_size_tb"), "is_compression_enabled")


def counter_rate(counters: DataFrame, name: str | None = None) -> DataFrame:
    """Change of a counter per second against the sample before, in millions, truncated."""
    rows = counters if name is None else counters.filter(F.trim("counter_name") == name)
    key = ["server_name", "counter_name", "instance_name"]
    pairs = adjacent.with_previous(rows, key, ["captured_at", "sample_id"], ["captured_at", "value"],
                                   adjacent.time_bucket("captured_at"))
    seconds = dates.boundary_diff("second", F.col("prev_captured_at"), F.col("captured_at"))
    change = F.col("value") - F.col("prev_value")
    per_second = F.when(seconds > 0, numbers.int_div(change, F.nullif(seconds, F.lit(0).cast("long"))))
    return pairs.filter(F.col("prev_captured_at").isNotNull()).select(
        "server_name", F.trim("counter_name").alias("counter_name"), F.trim("instance_name").alias("instance_name"),
        "sample_id", "captured_at", seconds.alias("seconds"), change.alias("change"), per_second.alias("rate_per_second"),
        numbers.int_div(per_second, 1000000).alias("rate_millions"))


def endpoint_permissions(permissions: DataFrame, endpoints: DataFrame, principals: DataFrame) -> DataFrame:
    """Who may use the mirroring endpoints."""
    points = endpoints.filter("type_desc = 'DATABASE_MIRRORING'").select(
        "server_name", F.col("endpoint_id").alias("major_id"), F.col("name").alias("mirror_endpoint_name"),
        F.col("state_desc").alias("endpoint_state"))
    people = principals.select("server_name", F.col("principal_id").alias("grantee_principal_id"),
                               F.col("name").alias("login_name"))
    return (permissions.filter("class_desc = 'ENDPOINT'").join(points, ["server_name", "major_id"])
            .join(people, ["server_name", "grantee_principal_id"])
            .select("server_name", "mirror_endpoint_name", "login_name", "permission_name",
                    F.col("state_desc").alias("permission_state"), "endpoint_state"))


def replica_connect_errors(replica_states: DataFrame, replicas: DataFrame) -> DataFrame:
    """Connection state of the local replicas."""
    return replica_states.filter("is_local").join(replicas, ["server_name", "replica_id"]).select(
        "server_name", "replica_server_name", "endpoint_url", "connected_state_desc",
        "last_connect_error_description", "last_connect_error_number", "last_connect_error_timestamp")


def replica_status(states: DataFrame, cluster_databases: DataFrame, groups: DataFrame, replicas: DataFrame,
                   as_of: str | datetime) -> DataFrame:
    """State of each replica database and minutes since its last commit."""
    databases = cluster_databases.select("server_name", "group_id", "group_database_id", "database_name")
    named = groups.select("server_name", "group_id", F.col("name").alias("ag_name"))
    hosts = replicas.select("server_name", "group_id", "replica_id", "replica_server_name")
    captured = [c for c in states.columns
                if c not in ("server_name", "group_id", "group_database_id", "replica_id", "is_suspended")]
    return (states.join(databases, ["server_name", "group_id", "group_database_id"])
            .join(named, ["server_name", "group_id"]).join(hosts, ["server_name", "group_id", "replica_id"])
            .select("server_name", "replica_server_name", "database_name", "ag_name", *captured,
                    dates.boundary_diff("minute", F.col("last_commit_time"), dates.instant(as_of))
                    .alias("minutes_since_last_commit")))


def suspended_replicas(states: DataFrame, cluster_databases: DataFrame, replicas: DataFrame,
                       replica_name: str | None = None) -> DataFrame:
    """Databases with suspended data movement and the text that resumes it."""
    hosts = replicas if replica_name is None else replicas.filter(F.col("replica_server_name") == replica_name)
    databases = cluster_databases.select("server_name", "group_id", "group_database_id", "database_name")
    resume = F.concat(F.lit("ALTER DATABASE ["), F.col("database_name"), F.lit("] SET HADR RESUME;"))
    return (states.filter("is_suspended").join(hosts.select("server_name", "replica_id", "replica_server_name"),
                                               ["server_name", "replica_id"])
            .join(databases, ["server_name", "group_id", "group_database_id"])
            .select("server_name", "replica_server_name", "database_name", resume.alias("resume_text")))
