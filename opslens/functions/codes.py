"""Decode tables and rule lists of the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------
# They must read exactly like this in the reports.
# ---------------------------------------------------------------------------

BACKUP_TYPES = {"D": "Database", "L": "Log", "I": "Differential"}
BACKUP_TYPES_UPPER = {"D": "FULL", "I": "DIFF", "L": "LOG"}
BACKUP_TYPES_SHORT = {"D": "Full", "I": "Diff", "L": "Log"}
RESTORE_TYPES = {"D": "Database", "F": "File", "I": "Differential", "L": "Log"}
GROWTH_KIND = {92: "ROWS", 93: "LOG"}
JOB_OUTCOMES = {0: "Failed", 1: "Succeeded", 2: "Retry", 3: "Canceled"}

TRANSACTION_STATES = {
    1: "The transaction has not been initialized.",
    3: "The transaction has been initialized but has not generated any log records.",
    4: "The transaction has generated log records.",
    5: "The transaction has been prepared.",
    10: "The transaction has been committed.",
    11: "The transaction has been rolled back.",
    12: "The transaction is being committed. In this state the log record is being generated, "
        "but it has not been materialized or persisted.",
}

ENCRYPTION_STATES = {
    0: "No database encryption key present, no encryption",
    1: "Unencrypted",
    2: "Encryption in progress",
    3: "Encrypted",
    4: "Key change in progress",
    5: "Decryption in progress",
    6: "Protection change in progress (The certificate or asymmetric key that is encrypting "
       "the database encryption key is being changed.)",
}

POWER_PLANS = {
    "a1841308-3541-4fab-bc81-f71556f20b4a": "power saving mode",
    "381b4222-f694-41f0-9685-ff5bb260df2e": "balanced power mode",
    "8c5e7fda-e8bf-4a96-9a85-a6e23a8c635c": "high performance power mode",
    "e9a42b02-d5df-448d-aa00-03f14749eb61": "ultimate performance power mode",
}

HA_ERRORS = {
    35202: "A connection for availability group ... has been successfully established...",
    1480: "The * database * is changing roles ... because the AG failed over ...",
    35206: "A connection timeout has occurred on a previously established connection ...",
    35201: "A connection timeout has occurred while attempting to establish a connection ...",
    41050: "Waiting for local WSFC service to start.",
    41051: "Local WSFC service started.",
    41052: "Waiting for local WSFC node to start.",
    41053: "Local WSFC node started.",
    41054: "Waiting for local WSFC node to come online.",
    41055: "Local WSFC node is online.",
    41048: "Local WSFC service has become unavailable.",
    41049: "Local WSFC node is no longer online.",
}

TRACE_EVENTS = {
    22: "ErrorLog",
    55: "Hash Warning",
    58: "Auto Stats",
    69: "Sort Warnings",
    79: "Missing Column Statistics",
    80: "Missing Join Predicate",
    92: "Data File Auto Grow",
    93: "Log File Auto Grow",
    115: "Audit Backup/Restore Event",
    116: "Audit DBCC Event",
    164: "Object:Altered",
}

# Phrases looked for in error logs.
SCAN_PHRASES = [
    "15 seconds",
    "deadlock",
    "stack dump",
    "Error:",
    "A significant part of sql server process memory has been paged out",
    "cachestore flush",
]

PAGED_OUT = "A significant part of sql server process memory has been paged out"
LONG_IO_MESSAGE = ("SQL Server has encountered XXX occurrence(s) of IO requests taking longer than "
                   "15 seconds to complete on file YYY")

# Comments by error number, first match wins in this order.
ERROR_COMMENTS = [
    ([825], "IO transient failure. Possible corruption"),
    ([833], "Long IO detected: http://support.microsoft.com/kb/897284"),
    ([855, 856], "Hardware memory corruption"),
    ([3452], "Metadata inconsistency in DB. Run DBCC CHECKIDENT"),
    ([3619], "Chkpoint failed. No Log space available"),
    ([9002], "No Log space available"),
    ([17204, 17207], "Error opening file during startup process"),
    ([17179], "No AWE - LPIM related"),
    ([17890], "sqlservr process paged out"),
    ([2508], "Catalog views inaccuracies in DB. Run DBCC UPDATEUSAGE"),
    ([2511], "Index Keys errors"),
    ([3271], "IO nonrecoverable error"),
    ([5228, 5229], "Online Index operation errors"),
    ([5242], "Page structural inconsistency"),
    ([5243], "In-memory structural inconsistency"),
    ([5250], "Corrupt page. Error cannot be fixed"),
    ([5901], "Chkpoint failed. Possible corruption"),
    ([17130], "No lock memory"),
    ([17300], "Unable to run new system task"),
    ([802], "No BP memory"),
    ([845, 1105, 1121], "No disk space available"),
    ([1214], "Internal parallelism error"),
    ([823, 824], "IO failure. Possible corruption"),
    ([832], "Page checksum error. Possible corruption"),
    ([3624, 17065, 17066, 17067], "System assertion check failed. Possible corruption"),
    ([5572], "Possible FILESTREAM corruption"),
    ([9100], "Possible index corruption"),
    ([17883], "Non-yielding scheduler: http://technet.microsoft.com/library/cc917684.aspx"),
    ([17884, 17888], "Deadlocked scheduler: http://technet.microsoft.com/library/cc917684.aspx"),
    ([17887], "IO completion error: http://technet.microsoft.com/library/cc917684.aspx"),
    ([1205], "Deadlocked transaction"),
    ([610], "Page header invalid. Possible corruption"),
    ([8621], "QP stack overflow during optimization. Please simplify the query"),
    ([8642], "QP insufficient threads for parallelism"),
    ([701], "Insufficient memory"),
    ([8645], "Insufficient memory: http://support.microsoft.com/kb/309256"),
    ([605], "Page retrieval failed. Possible corruption"),
    ([5180], "Invalid file ID. Possible corruption: http://support.microsoft.com/kb/2015747"),
    ([8966], "Unable to read and latch on a PFS or GAM page"),
    ([9001, 9002], "Transaction log errors."),
    ([9003, 9004, 9015], "Transaction log errors. Possible corruption"),
]
PAGED_OUT_COMMENT = "SQL Server process was trimmed by the OS. Preventable if LPIM is granted"
CACHE_FLUSH_COMMENT = "CacheStore flush"

# Alert rules: severities, error numbers, least seconds between two responses.
ALERT_SEVERITIES = range(16, 26)
ALERT_ERRORS = [823, 824, 825]
ALERT_DELAY_SECONDS = 60

# Progress milestones in percent with the end of their band, and the least gap in seconds.
MILESTONES = [(10, 50), (50, 80), (80, 95), (95, 100)]
MILESTONE_GAP_SECONDS = 600

# Editions by id.
ENTERPRISE_EDITIONS = [1804890536, 1872460670, 610778273]
DEVELOPER_EDITION = -2117995310
WEB_BI_EDITIONS = [284895786, 1293598313]
STANDARD_EDITION = -1534726760
EXPRESS_ENGINE = 4
UNSET_MAX_MEMORY = 2147483647

# ---------------------------------------------------------------------------


def decode(c: Column, table: dict, default: Column | str | None = None) -> Column:
    """Code to text by a small literal table, as a ``when`` chain."""
    out = None
    for code, text in table.items():
        out = F.when(c == code, text) if out is None else out.when(c == code, text)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def error_comment(message: Column) -> Column:
    """Comment for a log message: ordered rules, first match wins."""
    number = F.regexp_extract(message, r"^Error: (\d+)", 1)

    def is_error(numbers: list[int]) -> Column:
        return number.isin([str(n) for n in numbers])

    out = None
    for numbers, comment in ERROR_COMMENTS:
        rule = is_error(numbers)
        if numbers == [833]:
            rule = rule | is_long_io(message)
        out = F.when(rule, comment) if out is None else out.when(rule, comment)
    return (out.when(message.startswith(PAGED_OUT), PAGED_OUT_COMMENT)
            .when(message.contains("cachestore flush"), CACHE_FLUSH_COMMENT)
            .otherwise(""))


def is_long_io(message: Column) -> Column:
    return message.like("SQL Server has encountered % longer than 15 seconds %")
