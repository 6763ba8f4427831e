"""Registered log, trace, alert and event reports."""

from pyspark.sql import functions as F

from opslens.functions import codes
from opslens.functions.text import MESSAGE_PLACEHOLDERS
from opslens.plans import logs
from opslens.registry.common import AS_OF, Query

NOW = f"TIMESTAMP '{AS_OF}'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PHRASES = " UNION ALL ".join(f"SELECT {_q(p)} AS phrase" for p in codes.SCAN_PHRASES)
SCAN = f"""scan AS (SELECT l.*, p.phrase FROM {{errorlog}} l JOIN ({PHRASES}) p ON contains(lower(l.log_msg), lower(p.phrase)))"""
IS_NUMBERED = "regexp_matches({m}, '^Error: [^a-zA-Z]')"
LONG_IO = "SQL Server has encountered % longer than 15 seconds %"


def comment_sql(m: str) -> str:
    whens = []
    for numbers, comment in codes.ERROR_COMMENTS:
        conditions = [f"regexp_matches({m}, '^Error: ({'|'.join(map(str, numbers))})([^0-9]|$)')"]
        if numbers == [833]:
            conditions.append(f"{m} LIKE '{LONG_IO}'")
        whens.append(f"WHEN {' OR '.join(conditions)} THEN {_q(comment)}")
    whens.append(f"WHEN {m} LIKE '{codes.PAGED_OUT}%' THEN {_q(codes.PAGED_OUT_COMMENT)}")
    whens.append(f"WHEN {m} LIKE '%cachestore flush%' THEN {_q(codes.CACHE_FLUSH_COMMENT)}")
    return f"CASE {' '.join(whens)} ELSE '' END"


def pattern_sql(m: str) -> str:
    for mark in MESSAGE_PLACEHOLDERS:
        m = f"replace({m}, '{mark}', '%')"
    return f"regexp_replace({m}, '%+', '%', 'g')"


SUMMARY = f"""WITH {SCAN},
c AS (SELECT server_name, CASE WHEN {IS_NUMBERED.replace('{m}', 'log_msg')} AND strpos(log_msg, ',') > 0
      THEN substr(log_msg, 8, strpos(log_msg, ',') - 8)
      WHEN log_msg LIKE '{LONG_IO}' THEN '833' WHEN log_msg LIKE '{codes.PAGED_OUT}%' THEN '17890' END AS err,
    count(log_msg) AS n, log_date, CASE WHEN log_msg LIKE '{LONG_IO}' THEN {_q(codes.LONG_IO_MESSAGE)}
      WHEN log_msg LIKE '{codes.PAGED_OUT}%' THEN {_q(codes.PAGED_OUT + '.')} ELSE log_msg END AS m
  FROM scan GROUP BY server_name, log_msg, log_date)
SELECT server_name, 'Maintenance_Monitoring_checks' AS category, 'Errorlog_Summary' AS information, err AS error_number,
  sum(n) AS error_count, min(log_date) AS first_logged, max(log_date) AS last_logged, m AS logged_message, {comment_sql('m')} AS comment,
  CASE WHEN {IS_NUMBERED.replace('{m}', 'm')} THEN (SELECT {pattern_sql('text')} FROM {{messages}} WHERE message_id = CAST(err AS BIGINT)
    AND language_id = 1033) ELSE '' END AS look_for_message_example
FROM c GROUP BY server_name, err, m"""

ERRORS = """e AS (SELECT server_name, date_trunc('milliseconds', ts) AS logged_date, error_number, severity AS error_severity,
    error_state, message AS logged_message, user_id AS session_id FROM {xe_values} WHERE event_name = 'error_reported')"""

RULES = " UNION ALL ".join(
    [f"SELECT 'Severity {s:03d}' AS rule, 0 AS num, {s} AS sev" for s in codes.ALERT_SEVERITIES]
    + [f"SELECT 'Error Number {e}', {e}, 0" for e in codes.ALERT_ERRORS])
MATCHES = f"""m AS (SELECT server_name, rule, event_id, event_time, error_number, severity FROM {{alert_events}} a
    JOIN ({RULES}) r ON (r.num = 0 AND r.sev = a.severity) OR (r.num <> 0 AND r.num = a.error_number))"""

NAMES = "n(event_class, event_name) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in codes.TRACE_EVENTS.items()) + ")"
TRACE_COLUMNS = ", ".join(c if c == "event_name" else f"t.{c}" for c in logs.TRACE_COLUMNS)


def trace_sql(where: str) -> str:
    return f"SELECT server_name, event_id, {', '.join(logs.REPORT_COLUMNS)} FROM {{trace}} WHERE {where}"


def trace_query(classes: list[int], like: str | None = None, subclass: int | None = None) -> Query:
    where = f"event_class IN ({', '.join(map(str, classes))})"
    if like:
        where += f" AND text_data LIKE '{like}'"
    if subclass:
        where += f" AND event_subclass = {subclass}"
    return Query(lambda t: logs.trace_report(t.trace, classes, like, subclass), trace_sql(where))


ACC = """h AS (SELECT server_name AS ms, machine_name FROM {hosts}),
a AS (SELECT a.*, replace(output, chr(9), '') AS clean, upper(output) LIKE '%MSSQLSVC%' AS marked,
    upper(output) LIKE '%' || upper('MSSQLSvc/' || machine_name) || '%' AS mine, machine_name
  FROM {account_spn_lines} a JOIN h ON ms = server_name),
d AS (SELECT * FROM {duplicate_spn_lines}),
x AS (SELECT a.server_name, a.clean AS spn, b.line AS head, upper(b.output) LIKE '%' || upper('MSSQLSvc/' || machine_name) || '%' AS scoped,
    (SELECT min(line) FROM d z WHERE z.server_name = b.server_name AND z.line > b.line AND z.output IS NULL) AS stop
  FROM a JOIN d b ON a.server_name = b.server_name
    AND rtrim(upper(a.clean)) = rtrim(substr(replace(upper(b.output), chr(9), ''), 1, length(replace(a.output, ' ', ''))))
  WHERE a.marked),
dup AS (SELECT x.server_name, '[' || spn || ']' AS spn, '[' || replace(d.output, chr(9), '') || ']' AS account, scoped
  FROM x JOIN d ON d.server_name = x.server_name AND d.line > x.head AND d.line < x.stop)"""


def _finding(check: str, deviation: str, source: str, spn: str = "NULL", info: str = "NULL", distinct: str = "") -> str:
    return (f"SELECT {distinct} server_name, 'Service_Account_checks' AS category, '{check}' AS \"check\", {_q(deviation)} AS deviation, "
            f"{spn} AS spn, {info} AS information FROM {source}")


SPN = f"""WITH {ACC}, s AS (SELECT ms AS server_name, (SELECT count(*) FROM a WHERE server_name = ms AND marked) AS any_, (SELECT count(*) FROM a
    WHERE server_name = ms AND marked AND mine) AS own, (SELECT count(*) FROM dup WHERE server_name = ms) AS dups,
    (SELECT count(*) FROM dup WHERE server_name = ms AND scoped) AS scoped_dups FROM h)
""" + "\nUNION ALL ".join([
    _finding("MSSQLSvc_SPNs_SvcAcct_CurrServer", "[OK]", "a WHERE mine", "'[' || clean || ']'"),
    _finding("MSSQLSvc_SPNs_SvcAcct_CurrServer", "[WARNING: There is no registered MSSQLSvc SPN for the current service account in the scoped server name, preventing the use of Kerberos authentication]", "s WHERE any_ > 0 AND own = 0"),
    _finding("MSSQLSvc_SPNs_SvcAcct", "[INFORMATION: There are other MSSQLSvc SPNs registered for the current service account]", "a WHERE marked AND NOT mine", "'[' || clean || ']'"),
    _finding("MSSQLSvc_SPNs_SvcAcct", "[WARNING: There is no registered MSSQLSvc SPN for the current service account, preventing the use of Kerberos authentication]", "s WHERE any_ = 0"),
    _finding("Dup_MSSQLSvc_SPNs_Acct_CurrServer", "[WARNING: There are duplicate registered MSSQLSvc SPNs in the domain, for the SPN in the scoped server name]", "dup WHERE scoped", "spn", "account"),
    _finding("Dup_MSSQLSvc_SPNs_Acct_CurrServer", "[OK]", "s WHERE scoped_dups = 0"),
    _finding("Dup_MSSQLSvc_SPNs_Acct", "[WARNING: There are duplicate registered MSSQLSvc SPNs in the domain]", "dup", "spn", "account"),
    _finding("Dup_MSSQLSvc_SPNs_Acct", "[OK]", "s WHERE dups = 0"),
])


def document_lines(t):
    """Lines of every document with their number."""
    return t.documents.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"),
        F.posexplode(F.split("text", "\n")).alias("_n", "line")).select(
        "path", (F.col("_n") + 1).cast("long").alias("line_number"), "line")


QUERIES = {
    "errorlog_since": Query(lambda t: logs.errorlog_since(t.errorlog, AS_OF, 5),
                            f"SELECT * FROM {{errorlog}} WHERE log_date > date_trunc('day', {NOW} - INTERVAL 5 DAY)"),
    "errorlog_since_hours": Query(lambda t: logs.errorlog_since(t.errorlog, AS_OF, 100, "hour"),
                                  f"SELECT * FROM {{errorlog}} WHERE log_date > {NOW} - INTERVAL 100 HOUR"),
    "errorlog_scan": Query(lambda t: logs.errorlog_scan(t.errorlog), f"WITH {SCAN} SELECT * FROM scan"),
    "errorlog_summary": Query(lambda t: logs.errorlog_summary(logs.errorlog_scan(t.errorlog), t.messages), SUMMARY),
    "errorlog_finding": Query(
        lambda t: logs.errorlog_finding(t.databases, logs.errorlog_scan(t.errorlog)),
        f"""WITH {SCAN} SELECT server_name, 'Maintenance_Monitoring_checks' AS category, 'Errorlog' AS "check",
          CASE WHEN (SELECT count(*) FROM scan x WHERE x.server_name = s.server_name) > 0
            THEN '[WARNING: Errorlog contains important messages.]' ELSE '[OK]' END AS deviation
        FROM (SELECT DISTINCT server_name FROM {{databases}}) s"""),
    "health_error_summary": Query(
        lambda t: logs.health_error_summary(t.xe_targets, t.messages),
        f"""WITH {ERRORS} SELECT server_name, 'Maintenance_Monitoring_checks' AS category, 'SystemHealth_Errors_Summary' AS information,
          error_number, min(logged_date) AS first_logged, max(logged_date) AS last_logged, count(error_number) AS error_count,
          {pattern_sql('m.text')} AS look_for_message_example
        FROM e JOIN {{messages}} m ON m.message_id = e.error_number WHERE language_id = 1033 GROUP BY server_name, error_number, m.text"""),
    "health_error_detail": Query(
        lambda t: logs.health_error_detail(t.xe_targets),
        f"""WITH {ERRORS} SELECT server_name, 'Maintenance_Monitoring_checks' AS category, 'SystemHealth_Errors_Detail' AS information,
          logged_date, error_number, error_severity, error_state, logged_message, session_id FROM e"""),
    "health_finding": Query(
        lambda t: logs.health_finding(t.databases, t.xe_targets),
        """SELECT DISTINCT server_name, 'Maintenance_Monitoring_checks' AS category, 'SystemHealth_Errors' AS "check",
          CASE WHEN server_name IN (SELECT server_name FROM {xe_values} WHERE event_name = 'error_reported')
            THEN '[WARNING: System Health Session contains important messages.]' ELSE '[OK]' END AS deviation FROM {databases}"""),
    "spn_findings": Query(lambda t: logs.spn_findings(t.account_spn_lines, t.duplicate_spn_lines, t.hosts), SPN),
    "alert_matches": Query(lambda t: logs.alert_matches(t.alert_events), f"WITH {MATCHES} SELECT * FROM m"),
    "alert_rate_limited": Query(
        lambda t: logs.alert_responses(t.alert_events, delay_seconds=3600),
        f"""WITH RECURSIVE {MATCHES},
        k AS (SELECT server_name, rule, min(event_time) AS event_time FROM m GROUP BY 1, 2
          UNION ALL
          SELECT k.server_name, k.rule, (SELECT min(m.event_time) FROM m WHERE m.server_name = k.server_name AND m.rule = k.rule
            AND m.event_time >= k.event_time + INTERVAL 3600 SECOND) FROM k WHERE k.event_time IS NOT NULL)
        SELECT m.* FROM k JOIN m ON m.server_name = k.server_name AND m.rule = k.rule AND m.event_time = k.event_time"""),
    "trace_events": Query(
        lambda t: logs.trace_events(t.trace, logs.trace_event_names(t.spark)),
        f"WITH {NAMES} SELECT server_name, event_id, {TRACE_COLUMNS} FROM {{trace}} t JOIN n ON n.event_class = t.event_class"),
    "altered_objects": Query(
        lambda t: logs.altered_objects(t.trace, logs.trace_event_names(t.spark)),
        f"""WITH {NAMES} SELECT server_name, event_id, {TRACE_COLUMNS} FROM {{trace}} t JOIN n ON n.event_class = t.event_class
        WHERE t.event_class = 164 AND object_type = 16964"""),
    "trace_kinds": Query(
        lambda t: logs.trace_kinds(t.trace, logs.trace_event_names(t.spark)),
        f"WITH {NAMES} SELECT DISTINCT server_name, t.event_class, event_name FROM {{trace}} t JOIN n ON n.event_class = t.event_class"),
    "trace_occurrences": Query(
        lambda t: logs.trace_occurrences(t.trace, logs.trace_event_names(t.spark)),
        f"""WITH {NAMES} SELECT server_name, event_name, database_name, application_name, login_name, count(*) AS quantity
        FROM {{trace}} t JOIN n ON n.event_class = t.event_class GROUP BY 1, 2, 3, 4, 5"""),
    "trace_growth": Query(
        lambda t: logs.auto_growth(t.trace),
        """SELECT server_name, event_id, database_name, file_name, CASE event_class WHEN 92 THEN 'Data File Auto Grow'
          WHEN 93 THEN 'Log File Auto Grow' END AS event_class, duration, start_time, end_time, spid, application_name, login_name
        FROM {trace} WHERE event_class IN (92, 93)"""),
    "trace_shrinks": trace_query([116], "DBCC%SHRINK%"),
    "trace_checks": trace_query([116], "DBCC%CHECK%"),
    "trace_backups": trace_query([115], subclass=1),
    "trace_restores": trace_query([115], subclass=2),
    "trace_hash_warnings": trace_query([55]),
    "trace_missing_statistics": trace_query([79]),
    "trace_missing_join_predicates": trace_query([80]),
    "trace_sort_warnings": trace_query([69]),
    "trace_warnings": trace_query([55, 69, 79, 80]),
    "trace_errorlog": trace_query([22]),
    "trace_autostats": Query(
        lambda t: logs.trace_report(t.trace, [58], columns=["text_data", "object_id", "object_name", "index_id",
                                                            *logs.REPORT_COLUMNS[1:]]),
        """SELECT server_name, event_id, text_data, object_id, object_name, index_id, duration, start_time, end_time, spid,
          application_name, login_name FROM {trace} WHERE event_class = 58"""),
    "reboots": Query(lambda t: logs.reboots(t.os_events),
                     "SELECT machine_name, user_name, time_generated FROM {os_events} WHERE log_name = 'System' AND event_code = 1074"),
    "last_service_start": Query(
        lambda t: logs.last_service_start(t.os_events, "%service_3 service%running%"),
        """SELECT machine_name, time_generated, message FROM {os_events} o WHERE log_name = 'System' AND source = 'Service Control Manager'
          AND entry_type = 'Information' AND message LIKE '%service_3 service%running%' AND NOT EXISTS (SELECT 1 FROM {os_events} p
            WHERE p.machine_name = o.machine_name AND p.log_name = 'System' AND p.source = 'Service Control Manager'
              AND p.message LIKE '%service_3 service%running%' AND (p.time_generated, p.record_number) > (o.time_generated, o.record_number))"""),
    "os_events_between": Query(
        lambda t: logs.events_between(t.os_events, "2024-01-10 04:30:00", "2024-01-12 05:30:00"),
        """SELECT * FROM {os_events} WHERE time_generated > TIMESTAMP '2024-01-10 04:30:00' AND time_generated < TIMESTAMP '2024-01-12 05:30:00'"""),
    "audit_failures": Query(
        lambda t: logs.audit_failures(t.os_events, "2024-01-10 04:30:00", "2024-01-22 05:30:00"),
        """SELECT * FROM {os_events} WHERE time_generated > TIMESTAMP '2024-01-10 04:30:00' AND time_generated < TIMESTAMP '2024-01-22 05:30:00'
          AND log_name = 'Security' AND entry_type = 'FailureAudit'"""),
    "text_search": Query(
        lambda t: logs.grep_files(document_lines(t), "[Tt]he "),
        """SELECT 'doc_' || doc_id AS path, i AS line_number, line
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
        WHERE regexp_matches(line, '[Tt]he ')"""),
    "services_running": Query(
        lambda t: logs.services(t.services, "Running"),
        "SELECT server_name, name, display_name, state, path_name FROM {services} WHERE state = 'Running'"),
}
