"""Error log, trace, alert and operating-system event reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opslens.functions import codes, dates, text, xmls
from opslens.operators import adjacent, changes, greedy, joins, ranking

CATEGORY = "Maintenance_Monitoring_checks"


# -- error logs ---------------------------------------------------------------------------------

def errorlog_since(log: DataFrame, as_of: str | datetime, interval: int = 1, unit: str = "day") -> DataFrame:
    """Log rows after the start of a look-back of days (from midnight) or hours."""
    return log.filter(F.col("log_date") > dates.since(as_of, interval, unit))


def errorlog_scan(log: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """Rows that hold one of the phrases, once per phrase held; one pass over the logs."""
    wanted = phrases or codes.SCAN_PHRASES
    message = F.lower("log_msg")
    held = F.array_compact(F.array(*[F.when(message.contains(p.lower()), F.lit(p)) for p in wanted]))
    return log.withColumn("phrase", F.explode(held))


def _is_numbered(message: Column) -> Column:
    return message.rlike("^Error: [^a-zA-Z]")


def error_number(message: Column) -> Column:
    """Error number of a message as text; known texts without one get theirs."""
    return (F.when(_is_numbered(message), text.between_prefix_and_comma(message, "Error: "))
            .when(codes.is_long_io(message), "833")
            .when(message.startswith(codes.PAGED_OUT), "17890"))


def errorlog_summary(scan: DataFrame, messages: DataFrame, language: int = 1033) -> DataFrame:
    """Occurrences per error and normalised message, with comment and message template.

    Messages are normalised before the one aggregation, so equal texts are
    counted on the map side.
    """
    raw = F.col("log_msg")
    normal = (F.when(codes.is_long_io(raw), codes.LONG_IO_MESSAGE)
              .when(raw.startswith(codes.PAGED_OUT), codes.PAGED_OUT + ".").otherwise(raw))
    counted = (scan.select("server_name", "log_date", error_number(raw).alias("error_number"),
                           normal.alias("logged_message"))
               .groupBy("server_name", "error_number", "logged_message")
               .agg(F.count("*").alias("error_count"), F.min("log_date").alias("first_logged"),
                    F.max("log_date").alias("last_logged")))
    shown = F.col("logged_message")
    templates = messages.filter(F.col("language_id") == language).select(
        F.col("message_id").cast("long").alias("_id"), text.like_pattern(F.col("text")).alias("_example"))
    numbered = counted.withColumn("_id", F.when(_is_numbered(shown), F.col("error_number").try_cast("long")))
    example = F.when(_is_numbered(shown), F.col("_example")).otherwise("")
    return numbered.join(templates, "_id", "left").select(
        "server_name", F.lit(CATEGORY).alias("category"), F.lit("Errorlog_Summary").alias("information"),
        "error_number", "error_count", "first_logged", "last_logged", "logged_message",
        codes.error_comment(shown).alias("comment"), example.alias("look_for_message_example"))


def errorlog_finding(servers: DataFrame, scan: DataFrame) -> DataFrame:
    """One finding per server: whether its logs hold any of the phrases."""
    hits = scan.groupBy("server_name").agg(F.count("*").alias("hits"))
    return servers.select("server_name").distinct().join(hits, "server_name", "left").select(
        "server_name", F.lit(CATEGORY).alias("category"), F.lit("Errorlog").alias("check"),
        F.when(F.col("hits") > 0, "[WARNING: Errorlog contains important messages.]")
        .otherwise("[OK]").alias("deviation"))


# -- health session -----------------------------------------------------------------------------

def parse_events(xe: DataFrame, column: str = "event_xml", name: str | None = None) -> DataFrame:
    """Event documents parsed once: ``event``, ``event_name`` and ``event_time`` (UTC).

    The parse is the output of a generator, which filters on its fields cannot
    be pushed through; as a plain column it would be parsed again for each
    filter. A wanted ``name`` is looked for in the text before the parse. Rows that
    a reader has parsed already (with ``event``) are only filtered.
    """
    if column not in xe.columns and "event" in xe.columns:
        return xe if name is None else xe.filter(F.col("event_name") == name)
    wanted = xe if name is None else xe.filter(F.col(column).contains(name))
    others = [c for c in xe.columns if c != column]
    rows = wanted.select(*others, F.explode(F.array(xmls.parse(F.col(column), xmls.EVENT))).alias("event"))
    rows = (rows.withColumn("event_name", F.col("event")["_name"])
            .withColumn("event_time", xmls.event_time(F.col("event"))))
    return rows if name is None else rows.filter(F.col("event_name") == name)


def parse_targets(targets: DataFrame) -> DataFrame:
    """Ring buffer targets to one row per event; rows that a reader has parsed already stay as they are."""
    if "target_data" not in targets.columns:
        return targets
    events = F.explode(xmls.parse(F.col("target_data"), xmls.RING_TARGET)["event"])
    rows = targets.select("server_name", events.alias("event"))
    return (rows.withColumn("event_name", F.col("event")["_name"])
            .withColumn("event_time", xmls.event_time(F.col("event"))))


def _reported(targets: DataFrame) -> DataFrame:
    event = F.col("event")
    return parse_targets(targets).filter("event_name = 'error_reported'").select(
        "server_name", F.col("event_time").alias("logged_date"),
        xmls.named(event, "error_number").cast("long").alias("error_number"),
        xmls.named(event, "severity").cast("long").alias("error_severity"),
        xmls.named(event, "state").cast("long").alias("error_state"),
        xmls.named(event, "message").alias("logged_message"),
        xmls.named(event, "session_id", group="action").cast("long").alias("session_id"))


def health_error_summary(targets: DataFrame, messages: DataFrame, language: int = 1033) -> DataFrame:
    """Reported errors per number with first and last time and message template."""
    counted = _reported(targets).groupBy("server_name", "error_number").agg(
        F.min("logged_date").alias("first_logged"), F.max("logged_date").alias("last_logged"),
        F.count("error_number").alias("error_count"))
    templates = messages.filter(F.col("language_id") == language).select(
        F.col("message_id").cast("long").alias("error_number"),
        text.like_pattern(F.col("text")).alias("look_for_message_example"))
    return counted.join(templates, "error_number").select(
        "server_name", F.lit(CATEGORY).alias("category"),
        F.lit("SystemHealth_Errors_Summary").alias("information"), "error_number", "first_logged",
        "last_logged", "error_count", "look_for_message_example")


def health_error_detail(targets: DataFrame) -> DataFrame:
    return _reported(targets).select(
        "server_name", F.lit(CATEGORY).alias("category"),
        F.lit("SystemHealth_Errors_Detail").alias("information"), "logged_date", "error_number",
        "error_severity", "error_state", "logged_message", "session_id")


def health_finding(servers: DataFrame, targets: DataFrame) -> DataFrame:
    """One finding per server: whether its health session reported errors."""
    if "target_data" in targets.columns:  # most documents need not be parsed
        targets = targets.filter(F.col("target_data").contains("error_reported"))
    hits = (parse_targets(targets)
            .filter("event_name = 'error_reported'").select("server_name").distinct().withColumn("_hit", F.lit(True)))
    return servers.select("server_name").distinct().join(hits, "server_name", "left").select(
        "server_name", F.lit(CATEGORY).alias("category"), F.lit("SystemHealth_Errors").alias("check"),
        F.when(F.col("_hit"), "[WARNING: System Health Session contains important messages.]")
        .otherwise("[OK]").alias("deviation"))


# -- service principal names --------------------------------------------------------------------

SPN_MARK = "MSSQLSvc"
SPN_CATEGORY = "Service_Account_checks"


def _no_tabs(c: str) -> Column:
    return F.replace(F.col(c), F.lit("\t"), F.lit(""))


def spn_duplicates(account_lines: DataFrame, duplicate_lines: DataFrame, machines: DataFrame) -> DataFrame:
    """Accounts that share a service principal name of the service account.

    A printed block is a header with the name, its accounts, and an empty line.
    Lines meet their header through the number of the block.
    """
    names = account_lines.filter(F.upper("output").contains(SPN_MARK.upper())).select(
        "server_name", _no_tabs("output").alias("spn"), F.rtrim(F.upper(_no_tabs("output"))).alias("_prefix"),
        F.length(F.replace(F.col("output"), F.lit(" "), F.lit(""))).alias("_length"))
    blocks = adjacent.carry_forward(
        duplicate_lines, ["server_name"], "line", F.when(F.col("output").isNull(), F.col("line")),
        adjacent.line_bucket("line"), "block").filter("output is not null").withColumn(
            "block", F.coalesce("block", F.lit(-1)))
    headers = blocks.select("server_name", "block", F.col("line").alias("_header"), F.col("output").alias("_head"),
                            F.upper(_no_tabs("output")).alias("_text"))
    found = joins.prefix_join(names, headers, ["server_name"], "_prefix", "_length", "_text")
    accounts = blocks.select("server_name", "block", "line", _no_tabs("output").alias("account"))
    scoped = F.upper("_head").contains(F.upper(F.concat(F.lit(SPN_MARK + "/"), F.col("machine_name"))))
    return (found.join(accounts, ["server_name", "block"]).filter(F.col("line") > F.col("_header"))
            .join(machines.select("server_name", "machine_name"), "server_name")
            .select("server_name", "line", text.quote_name(F.col("spn")).alias("spn"),
                    text.quote_name(F.col("account")).alias("account"), scoped.alias("is_scoped")))


# Checks and what they say.
SPN_MINE, SPN_ANY = "MSSQLSvc_SPNs_SvcAcct_CurrServer", "MSSQLSvc_SPNs_SvcAcct"
SPN_DUP_MINE, SPN_DUP_ANY = "Dup_MSSQLSvc_SPNs_Acct_CurrServer", "Dup_MSSQLSvc_SPNs_Acct"
SPN_TEXTS = {
    "ok": "[OK]",
    "other": "[INFORMATION: There are other MSSQLSvc SPNs registered for the current service account]",
    "none_here": "[WARNING: There is no registered MSSQLSvc SPN for the current service account in the scoped server "
                 "name, preventing the use of Kerberos authentication]",
    "none": "[WARNING: There is no registered MSSQLSvc SPN for the current service account, preventing the use of "
            "Kerberos authentication]",
    "dup_here": "[WARNING: There are duplicate registered MSSQLSvc SPNs in the domain, for the SPN in the scoped server name]",
    "dup": "[WARNING: There are duplicate registered MSSQLSvc SPNs in the domain]",
}


def spn_findings(account_lines: DataFrame, duplicate_lines: DataFrame, machines: DataFrame) -> DataFrame:
    """Registered, missing and duplicate service principal names, as findings per server.

    Each line, each duplicate and each server is turned into its findings in
    one pass over it.
    """
    marked = F.upper("output").contains(SPN_MARK.upper())
    mine = F.upper("output").contains(F.upper(F.concat(F.lit(SPN_MARK + "/"), F.col("machine_name"))))
    lines = (account_lines.join(machines.select("server_name", "machine_name"), "server_name")
             .select("server_name", text.quote_name(_no_tabs("output")).alias("spn"),
                     marked.alias("_marked"), mine.alias("_mine")))
    duplicates = spn_duplicates(account_lines, duplicate_lines, machines)
    none = F.lit(None).cast("string")

    def finding(when: Column, check: str, deviation: str, spn: Column = none, information: Column = none) -> Column:
        return F.when(when, F.struct(
            F.lit(check).alias("check"), F.lit(SPN_TEXTS[deviation]).alias("deviation"), spn.alias("spn"),
            information.alias("information")))

    def spread(df: DataFrame, findings: list[Column]) -> DataFrame:
        rows = df.select("server_name", F.explode(F.array_compact(F.array(*findings))).alias("f"))
        return rows.select("server_name", F.lit(SPN_CATEGORY).alias("category"), "f.*")

    def has(c: str) -> Column:
        return F.coalesce(c, F.lit(False))

    by_line = lines.groupBy("server_name").agg(
        F.max("_marked").alias("_any"), F.max(F.col("_mine") & F.col("_marked")).alias("_own"))
    by_duplicate = duplicates.groupBy("server_name").agg(
        F.lit(True).alias("_dup"), F.max("is_scoped").alias("_dup_own"))
    servers = (machines.select("server_name").join(by_line, "server_name", "left")
               .join(by_duplicate, "server_name", "left"))
    spn, account = F.col("spn"), F.col("account")
    return changes.union_all([
        spread(lines, [finding(F.col("_mine"), SPN_MINE, "ok", spn),
                       finding(F.col("_marked") & ~F.col("_mine"), SPN_ANY, "other", spn)]),
        spread(duplicates, [finding(F.col("is_scoped"), SPN_DUP_MINE, "dup_here", spn, account),
                            finding(F.lit(True), SPN_DUP_ANY, "dup", spn, account)]),
        spread(servers, [finding(has("_any") & ~has("_own"), SPN_MINE, "none_here"),
                         finding(~has("_any"), SPN_ANY, "none"),
                         finding(~has("_dup_own"), SPN_DUP_MINE, "ok"),
                         finding(~has("_dup"), SPN_DUP_ANY, "ok")]),
    ])


# -- alerts -------------------------------------------------------------------------------------

def default_alert_rules(spark: SparkSession) -> DataFrame:
    """Rules by severity and by error number; a 0 means the other one decides."""
    rows = [(f"Severity {s:03d}", 0, s) for s in codes.ALERT_SEVERITIES]
    rows += [(f"Error Number {e}", e, 0) for e in codes.ALERT_ERRORS]
    return spark.createDataFrame(rows, "rule string, message_id long, rule_severity long")


def alert_matches(events: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Each event with every rule that fires for it, as two equi-joins."""
    rules = rules if rules is not None else default_alert_rules(events.sparkSession)
    by_severity = events.join(
        rules.filter("message_id = 0").select("rule", F.col("rule_severity").alias("severity")), "severity")
    by_error = events.join(
        rules.filter("message_id <> 0").select("rule", F.col("message_id").alias("error_number")), "error_number")
    return by_severity.unionByName(by_error).select(
        "server_name", "rule", "event_id", "event_time", "error_number", "severity")


def alert_responses(events: DataFrame, rules: DataFrame | None = None,
                    delay_seconds: int = codes.ALERT_DELAY_SECONDS) -> DataFrame:
    """Matches that lead to a response: per server and rule at least the delay apart."""
    return greedy.keep_gap(alert_matches(events, rules), ["server_name", "rule"], "event_time", "event_id",
                           delay_seconds)


# -- traces -------------------------------------------------------------------------------------

def trace_event_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(codes.TRACE_EVENTS.items()), "event_class long, event_name string")


TRACE_COLUMNS = ["event_class", "event_name", "text_data", "object_id", "object_name", "database_name",
                 "login_name", "start_time", "application_name", "host_name", "nt_user_name", "nt_domain_name"]


def trace_events(trace: DataFrame, names: DataFrame) -> DataFrame:
    """All captured trace events with their names."""
    return trace.join(names, "event_class").select("server_name", "event_id", *TRACE_COLUMNS)


def altered_objects(trace: DataFrame, names: DataFrame) -> DataFrame:
    """Database objects that were altered."""
    return trace_events(trace.filter("event_class = 164 and object_type = 16964"), names)


def trace_kinds(trace: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct kinds of captured events; reduced before the names are joined."""
    return trace.select("server_name", "event_class").distinct().join(names, "event_class").select(
        "server_name", "event_class", "event_name")


def trace_occurrences(trace: DataFrame, names: DataFrame) -> DataFrame:
    """Events counted by kind, database, application and login."""
    keys = ["server_name", "database_name", "application_name", "login_name"]
    counted = trace.groupBy(*keys, "event_class").agg(F.count("*").alias("_n"))
    return counted.join(names, "event_class").groupBy(*keys, "event_name").agg(F.sum("_n").alias("quantity"))


REPORT_COLUMNS = ["text_data", "duration", "start_time", "end_time", "spid", "application_name", "login_name"]


def trace_report(trace: DataFrame, event_classes: list[int], text_like: str | None = None,
                 subclass: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Events of some classes, optionally of a subclass or with a text pattern."""
    rows = trace.filter(F.col("event_class").isin(*event_classes))
    if subclass is not None:
        rows = rows.filter(F.col("event_subclass") == subclass)
    if text_like is not None:
        rows = rows.filter(F.col("text_data").like(text_like))
    return rows.select("server_name", "event_id", *(columns or REPORT_COLUMNS))


def auto_growth(trace: DataFrame) -> DataFrame:
    rows = trace_report(trace, [92, 93], columns=["database_name", "file_name", "event_class", "duration", "start_time",
                                                  "end_time", "spid", "application_name", "login_name"])
    return rows.withColumn("event_class", codes.decode(F.col("event_class"), codes.TRACE_EVENTS))


# -- operating system events --------------------------------------------------------------------

def reboots(events: DataFrame, newest: int | None = None) -> DataFrame:
    """System log entries of a shutdown, optionally among the newest entries only."""
    log = events.filter("log_name = 'System'")
    if newest is not None:
        log = log.orderBy(F.desc("time_generated"), "machine_name", "record_number").limit(newest)
    return log.filter("event_code = 1074").select("machine_name", "user_name", "time_generated")


def last_service_start(events: DataFrame, message_like: str, source: str = "Service Control Manager") -> DataFrame:
    """Newest matching service message per machine."""
    rows = events.filter((F.col("log_name") == "System") & (F.col("source") == source)
                         & (F.col("entry_type") == "Information") & F.col("message").like(message_like))
    return ranking.latest_rows(rows, ["machine_name"], [F.desc("time_generated"), F.desc("record_number")]).select(
        "machine_name", "time_generated", "message")


def events_between(events: DataFrame, begin: str | datetime, end: str | datetime,
                   logs: list[str] | None = None) -> DataFrame:
    rows = events.filter((F.col("time_generated") > dates.instant(begin)) & (F.col("time_generated") < dates.instant(end)))
    return rows.filter(F.col("log_name").isin(*logs)) if logs else rows


def audit_failures(events: DataFrame, begin: str | datetime, end: str | datetime) -> DataFrame:
    return events_between(events, begin, end, ["Security"]).filter("entry_type = 'FailureAudit'")


def grep_files(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that match a pattern, with path and line number."""
    return lines.filter(F.col("line").rlike(pattern)).select("path", "line_number", "line")


def services(rows: DataFrame, state: str | None = None) -> DataFrame:
    kept = rows.filter(F.col("state") == state) if state is not None else rows
    return kept.select("server_name", "name", "display_name", "state", "path_name")


def probe_failures(probes: DataFrame) -> DataFrame:
    """Failed probes as log rows."""
    return probes.filter("not answered").select(
        "server_name", "probed_at",
        F.concat(F.col("server_name"), F.lit(" : "), dates.style_text(F.col("probed_at"), 120),
                 F.lit(" - Request Timed Out")).alias("line"))
