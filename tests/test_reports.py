"""Reports on literal rows: boundaries, ties, nulls, empty input, equal names on two servers."""

import pytest

from helpers import at, frame, rows
from opslens.plans import availability, backup, inventory, jobs, lists, logs, ordering, security, storage, workload
from opslens.sources.schemas import schema_of

NOW = "2024-01-31 12:00:00"
BACKUP = ("server_name string, backup_set_id long, media_set_id long, database_name string, name string, type string, "
          "backup_start_date timestamp_ntz, backup_finish_date timestamp_ntz, backup_size double, "
          "compressed_backup_size double, user_name string, is_copy_only boolean, is_snapshot boolean, recovery_model string")
MEDIA = "server_name string, media_set_id long, device_type int, physical_device_name string"
DATABASES = ("server_name string, database_id long, name string, state_desc string, recovery_model_desc string, "
             "is_read_only boolean, is_in_standby boolean, log_reuse_wait_desc string, compatibility_level long, "
             "user_access_desc string")


def one(n, start, finish=None, server="s1", db="db", kind="D", size=2.0 ** 31, small=2.0 ** 30, user="dba", copy=False,
        snap=False):
    return (server, n, n, db, f"bak_{n}", kind, at(start), at(finish or start), size, small, user, copy, snap, "FULL")


def backups(spark, *data):
    return frame(spark, list(data), BACKUP)


def media(spark, *data):
    return frame(spark, list(data), MEDIA)


def databases(spark, *names, server="s1", state="ONLINE", model="FULL", read_only=False, standby=False):
    return frame(spark, [(server, 10 + i, n, state, model, read_only, standby, "NOTHING", 150, "MULTI_USER")
                         for i, n in enumerate(names)], DATABASES)


# -- backup -------------------------------------------------------------------------------------

def test_frequency_counts_strictly_earlier_backups_only(spark):
    df = backups(
        spark, one(1, "2024-01-01 00:00:00"),              # only a predecessor: older than 30 days
        one(2, "2024-01-03 00:00:00"), one(3, "2024-01-03 00:00:00"),  # equal times: both 48 h after the first
        one(4, "2024-01-05 12:00:00"),
        one(5, "2024-01-04 00:00:00", copy=True),          # copy-only rows do not exist for this report
        one(6, "2023-12-01 00:00:00"),                     # beyond the horizon
        one(7, "2024-01-05 00:00:00", server="s2"),        # same name elsewhere, nothing before it
        one(8, "2024-01-06 00:00:00", kind="L"))
    got = backup.backup_frequency(df, NOW, 30, 40)
    assert rows(got) == [("s1", "db", "D", 52.0), ("s1", "db", "L", None), ("s2", "db", "D", None)]


def test_frequency_without_copy_only_column(spark):
    df = backups(spark, one(1, "2024-01-30 00:00:00"), one(2, "2024-01-30 03:00:00", copy=True)).drop("is_copy_only")
    assert rows(backup.backup_frequency(df, NOW), "avg_hours") == [(3.0,)]


def test_device_classes(spark):
    names = ["{guid}1", "Legato#x", "TDPSQL-1", "C:\\b.bak", "\\\\share\\b", "VNBU0-1", "odd", "odd2", "{open"]
    df = backups(spark, *[one(i, "2024-01-30 00:00:00") for i in range(len(names))])
    tapes = media(spark, *[("s1", i, 7 if n == "odd" else 2, n) for i, n in enumerate(names)])
    got = backup.backup_devices(df, tapes, NOW)
    assert rows(got, "dev", "cnt") == [("Native", 2), ("NetBackup", 1), ("Networker", 1), ("Other", 1), ("Snapshot", 1),
                                       ("Tivoli", 1), ("odd2", 1), ("{open", 1)]
    wide = backup.backup_frequency_wide(df, tapes, NOW)
    assert rows(wide, "dev_d", "dev_l") == [("Native", None)]


def test_dominant_device_keeps_ties(spark):
    df = frame(spark, [("s", "d", "a", "D", 2), ("s", "d", "b", "D", 2), ("s", "d", "c", "D", 1), ("t", "d", "c", "D", 1)],
               "server_name string, database_name string, dev string, type string, cnt long")
    assert rows(backup.dominant_device(df), "server_name", "dev") == [("s", "a"), ("s", "b"), ("t", "c")]


def test_history_drops_only_copy_only_snapshots(spark):
    df = backups(spark, one(1, "2024-01-31 01:00:00", "2024-01-31 01:01:00"), one(2, "2024-01-31 01:00:00", copy=True),
                 one(3, "2024-01-31 01:00:00", copy=True, snap=True), one(4, "2024-01-31 01:00:00", kind="L"),
                 one(5, "2024-01-30 11:59:59"), one(6, "2024-01-30 12:00:00", "2024-01-30 13:00:00"))
    got = backup.backup_history(df, media(spark, *[("s1", i, 2, "x") for i in range(7)]), NOW)
    assert rows(got, "backup_set_id", "duration") == [(1, "Duration: 1.00 min"), (2, "Duration: 0.00 sec"),
                                                      (6, "Duration: 1.00 hr")]


def test_last_backups(spark):
    df = backups(spark, one(1, "2024-01-30 00:00:00"), one(2, "2024-01-31 00:00:00", "2024-01-31 00:30:00"),
                 one(3, "2024-01-31 01:00:00", user="agent", small=0.0), one(4, "2024-01-31 02:00:00", copy=True),
                 one(5, "2024-01-31 00:00:00", server="s2"))
    got = backup.last_backups(df, databases(spark, "db"), media(spark, *[(s, i, 2, "x") for i in range(6) for s in ("s1", "s2")]), NOW)
    assert rows(got, "user_name", "run_time", "time_since_backup", "compression_ratio") == [
        ("agent", "Duration: 0.00 sec", "Duration: 11.00 hr", None),
        ("dba", "Duration: 30.00 min", "Duration: 11.50 hr", got.filter("user_name = 'dba'").first()["compression_ratio"])]
    assert float(got.filter("user_name = 'dba'").first()["compression_ratio"]) == 2.0


def test_stale_and_never(spark):
    df = backups(spark, one(1, "2024-01-29 12:00:00", db="edge"), one(2, "2024-01-29 11:59:59", db="old"),
                 one(3, "2024-01-01 00:00:00", db="logs", kind="L"))
    known = databases(spark, "edge", "old", "logs", "never", "tempdb").unionByName(
        databases(spark, "off", state="OFFLINE")).unionByName(databases(spark, "old", server="s2"))
    got = backup.stale_backups(df, known, NOW)
    assert rows(got, "server_name", "database_name", "backup_age_hours") == [
        ("s1", "never", 9999), ("s1", "old", 49), ("s2", "old", 9999)]


def test_latest_by_type_keeps_ties(spark):
    df = backups(spark, one(1, "2024-01-30 00:00:00"), one(2, "2024-01-30 00:00:00", user="x"), one(3, "2024-01-29 00:00:00"))
    got = backup.latest_by_type(df, NOW)
    assert rows(got, "user_name", "type", "minutes_since") == [("dba", "FULL", 2160), ("x", "FULL", 2160)]


def test_missing_days(spark):
    df = backups(spark, one(1, "2024-01-28 23:59:59"), one(2, "2024-01-27 11:00:00"), one(3, "2024-01-30 00:00:00", kind="I"))
    got = backup.missing_backup_days(df, databases(spark, "db", "tempdb"), NOW)
    # The backup of the 27th began before the look-back of four whole days.
    assert [str(r[0]) for r in rows(got, "day")] == ["2024-01-27", "2024-01-29", "2024-01-30"]


def test_findings(spark):
    df = backups(spark, one(1, "2024-01-30 12:00:00", db="edge"), one(2, "2024-01-30 11:59:59", db="day", kind="I"),
                 one(3, "2024-01-24 12:00:00", db="week"), one(4, "2024-01-24 11:59:59", db="older"),
                 one(5, "2024-01-31 11:00:00", db="edge", kind="L"), one(6, "2024-01-31 10:59:59", db="day", kind="L"),
                 one(7, "2024-01-31 00:00:00", db="never", snap=True))
    known = databases(spark, "edge", "day", "week", "older", "never").unionByName(databases(spark, "standby", standby=True))
    got = {r[0] for r in rows(backup.data_backup_findings(known, df, NOW), "details")}
    assert got == {
        "Database day last backed up: 2024-01-30 11:59:59 (1 day ago) (differential backup)",
        "Database week last backed up: 2024-01-24 12:00:00 (7 days ago)",
        "Database older last backed up over a week ago: 2024-01-24 11:59:59 (7 days ago)",
        "Database never never backed up."}
    simple = databases(spark, "simple", model="SIMPLE").unionByName(databases(spark, "ro", read_only=True))
    got = {r[0] for r in rows(backup.log_backup_findings(known.unionByName(simple), df, NOW), "details")}
    assert got == {"Database day had its last log backup on: 2024-01-31 10:59:59 (61 mins ago)"} | {
        f"Database {n} has never had a log backup." for n in ("week", "older", "never")}
    preferred = frame(spark, [("s1", "never")], "server_name string, database_name string")
    assert backup.data_backup_findings(known, df, NOW, preferred).count() == 3


def test_backup_state(spark):
    df = backups(spark, one(1, "2024-01-30 12:30:00", db="ok"), one(2, "2024-01-01 00:00:00", db="diff"),
                 one(3, "2024-01-31 00:00:00", db="diff", kind="I"), one(4, "2024-01-31 00:00:00", db="system", user="NT AUTHORITY\\SYSTEM"))
    known = databases(spark, "ok", "diff", "system", "none", "tempdb")
    got = backup.backup_state(df, known, NOW)
    # 12:30 the day before is 24 hour boundaries away.
    assert rows(got, "database_name", "hr_since_full") == [("none", None), ("ok", 24), ("system", None)]
    roles = frame(spark, [("s1", "none", "PRIMARY")], "server_name string, database_name string, role_desc string")
    assert rows(backup.backup_state(df, known, NOW, roles), "database_name", "ag") == [
        ("none", "PRIMARY"), ("ok", None), ("system", None)]


def test_backup_html_keeps_document_order(spark):
    df = backups(spark, one(1, "2024-01-31 00:00:00", db="<b>"), one(2, "2024-01-31 00:00:00", kind="L"))
    got = ordering.in_order(backup.backup_history_html(df, media(spark, ("s1", 1, 2, "x&y"), ("s1", 2, 2, "z")), NOW), "backup_html_rows")
    html = [r["html"] for r in got.collect()]
    assert html[0].startswith("<html>") and html[-1] == "</table></body></html>" and len(html) == 3
    assert "&lt;b&gt;" in html[1] and "x&amp;y" in html[1]


def test_empty_input(spark):
    none = backups(spark).limit(0)
    for report in (backup.backup_frequency(none, NOW), backup.latest_by_type(none, NOW), backup.backup_size_delta(none),
                   backup.backup_history(none, media(spark).limit(0), NOW)):
        assert report.count() == 0
    assert backup.stale_backups(none, databases(spark, "a"), NOW).count() == 1


# -- jobs ---------------------------------------------------------------------------------------

JOBS = "server_name string, job_id long, name string"
HISTORY = ("server_name string, instance_id long, job_id long, step_id long, run_status int, run_date long, run_time long, "
           "run_duration long")


def test_drift_needs_the_newest_row_to_be_a_summary(spark):
    names = frame(spark, [("s", 1, "one"), ("s", 2, "two"), ("t", 1, "other")], JOBS)
    history = frame(spark, [
        ("s", 1, 1, 0, 1, 20240130, 0, 100), ("s", 2, 1, 0, 1, 20240131, 0, 205),
        ("s", 3, 2, 0, 1, 20240131, 0, 100), ("s", 4, 2, 1, 1, 20240131, 0, 100),
        ("t", 9, 1, 0, 1, 20240101, 0, 500)], HISTORY)
    got = jobs.job_runtime_drift(names, history, NOW, 5)
    assert rows(got, "job_name", "duration_seconds", "avg_seconds", "diff_seconds") == [("one", 125, 92, 33)]
    got = jobs.job_runtime_drift(names, history, NOW, 5, latest_over="step0")
    assert rows(got, "job_name") == [("one",), ("two",)]


def test_running_at_includes_both_ends(spark):
    names = frame(spark, [("s", 1, "one")], JOBS)
    history = frame(spark, [("s", 1, 1, 0, 1, 20240130, 235900, 200), ("s", 2, 1, 1, 1, 20240130, 235900, 200),
                            ("s", 3, 1, 0, 1, 20240101, 0, 1000000)], HISTORY)
    for moment, n in (("2024-01-30 23:59:00", 1), ("2024-01-31 00:01:00", 1), ("2024-01-31 00:01:01", 0),
                      ("2024-01-02 00:00:00", 1)):
        assert jobs.jobs_running_at(names, history, moment).count() == n
    assert jobs.jobs_in_hours(names, history, 0, 0, ["2024-01-31"]).count() == 1


def test_copy_plan(spark):
    members = frame(spark, [("g", "p", "Primary"), ("g", "a", "Secondary"), ("g", "b", "Secondary"), ("h", "q", "Primary")],
                    "group_name string, replica_name string, role string")
    names = frame(spark, [("g", "j1"), ("g", "j2"), ("h", "j3")], "group_name string, name string")
    got = jobs.job_copy_plan(names, members, include=["j1", "j2", "j3"], exclude=["j2"])
    assert rows(got, "job_name", "source", "destination") == [("j1", "p", "a"), ("j1", "p", "b")]


# -- storage ------------------------------------------------------------------------------------

FILES = schema_of("master_files")


def file(n, db="db", kind=0, size=12800, used=6400, growth=10, percent=True, name=None, path=None, limit=-1, database_id=10):
    return ("s1", database_id, db, n, kind, "LOG" if kind else "ROWS", name or f"f{n}", path or f"D:\\f{n}.{'ldf' if kind else 'mdf'}",
            size, used, growth, percent, limit, 1)


VOLUMES = "server_name string, volume_id long, mount_point string, logical_volume_name string, total_bytes long, available_bytes long"


def test_full_and_empty_volumes(spark):
    files = frame(spark, [file(1), file(2, db="master")], FILES)
    gb = 2 ** 30
    got = storage.disk_space(files, frame(spark, [("s1", 1, "D:\\", "data", 100 * gb, 0)], VOLUMES)).first()
    assert (float(got["disk_free_percent"]), float(got["target_add_gb"]), float(got["total_target_gb"])) == (0.0, 17.65, 17.65)
    got = storage.disk_space(files, frame(spark, [("s1", 1, "D:\\", "data", 0, 0)], VOLUMES)).first()
    assert got["disk_free_percent"] is None


def test_log_space_of_an_empty_file(spark):
    files = frame(spark, [file(1, kind=1, size=0, used=0)], FILES)
    got = storage.log_space(files, databases(spark, "db")).first()
    assert got["free_percent"] is None
    assert got["shrink_text"] == "USE [db]\r\nDBCC SHRINKFILE (N'f1' , 0);\r\n\r\n"


def test_growth_policy(spark):
    files = frame(spark, [file(1), file(2, growth=128, percent=False), file(3, growth=64 * 128, percent=False),
                          file(4, growth=65 * 128, percent=False, limit=0), file(5, growth=20), file(6, db="tempdb", kind=1),
                          file(7, path="D:\\x.ndf")], FILES)
    got = {r["logical_name"]: r for r in storage.growth_policy(files).collect()}
    assert sorted(got) == ["f1", "f2", "f4", "f6", "f7"]
    assert got["f4"]["max_size"] == "No growth is allowed"
    assert "FILEGROWTH = 512MB" in got["f6"]["change_autogrow"]
    assert got["f7"]["change_autogrow"] == "Error - Invalid Option"


def test_size_share(spark):
    files = frame(spark, [file(1, db="a", size=300), file(2, db="b", size=100)], FILES)
    assert rows(storage.size_share(files), "database_name", "graph") == [("a", "|" * 75), ("b", "|" * 25)]


def test_orphaned_files(spark):
    inventory_ = frame(spark, [("s1", p, 3 * 2 ** 20, at("2024-01-01 00:00:00")) for p in (
        "D:\\F1.MDF", "D:\\f9.ldf", "C:\\f9.mdf", "D:\\$RECYCLE_BIN\\f.mdf", "E:\\x.bak")] + [
        ("s2", "D:\\f1.mdf", 1, at("2024-01-01 00:00:00"))], schema_of("file_inventory"))
    got = storage.orphaned_files(inventory_, frame(spark, [file(1)], FILES), NOW)
    assert rows(got, "server_name", "path", "size_mb", "days_old") == [("s1", "D:\\f9.ldf", 3, 30), ("s2", "D:\\f1.mdf", 0, 30)]


def test_volumes_from_xml_keeps_line_order(spark):
    lines = frame(spark, [("s", 3, '<Property Name="capacityMB">2.5</Property></Object></Objects>'), ("s", 1, "<Objects>"),
                          ("s", 2, '<Object><Property Name="Name">D:</Property>'), ("s", 4, None)],
                  "server_name string, line long, output string")
    got = storage.volumes_from_xml(lines).first()
    assert (got["volume"], got["free_space_mb"], float(got["capacity_mb"])) == ("D:", None, 2.5)


# -- workload -----------------------------------------------------------------------------------

def test_blocking_tree_leaves_out_cycles_and_idle_heads(spark):
    processes = frame(spark, [("s", 1, 0, "a\nb"), ("s", 2, 1, "x"), ("s", 3, 2, "y"), ("s", 4, 0, "idle"), ("s", 5, 5, "self"),
                              ("s", 6, 5, "z"), ("s", 7, 8, "c"), ("s", 8, 7, "c"), ("t", 1, 0, "other")],
                      "server_name string, spid long, blocked long, batch string")
    got = ordering.in_order(workload.blocking_tree(processes), "blocking_tree")
    assert [r["blocking_tree"] for r in got.collect()] == [
        "    HEAD -  1 a b", "    |         |------  2 x", "    |         |         |------  3 y", "    HEAD -  5 self",
        "    |         |------  6 z"]
    assert rows(workload.block_leaders(processes), "session_id", "blocked_session_count", "max_depth") == [(1, 2, 2), (5, 1, 1)]


def test_address_space_counts_equal_free_regions_once(spark):
    regions = frame(spark, [("s", 0, 4096), ("s", 0, 4096), ("s", 0, 8192), ("s", 7, 99999)],
                    "server_name string, allocation_base long, region_size long")
    assert rows(workload.address_space(regions)) == [("s", 12, 8)]
    assert rows(workload.address_space(regions, dedupe=False)) == [("s", 16, 8)]


HOSTS = ("server_name string, max_workers_count long, total_physical_memory_kb long, edition_id long, engine_edition long, "
         "major_version long, version_banner string, max_server_memory_mb long, running_memory_mb long, min_server_memory_mb long, "
         "system_manufacturer string, is_clustered boolean")


@pytest.mark.parametrize("gb, edition, major, want", [
    (1, 1804890536, 15, 1024 * 1 - 512 - 1024), (8, 1804890536, 15, 8192 - 3072 - 1024), (32, 1804890536, 15, 32768 - 7168 - 1024),
    (256, -1534726760, 15, 131072), (130, -1534726760, 15, (130 - 19) * 1024), (96, -1534726760, 9, 65536),
    (256, -2117995310, 15, (256 - 35 - 1) * 1024)])
def test_memory_recommendation(spark, gb, edition, major, want):
    hosts = frame(spark, [("s", 512, gb * 2 ** 20, edition, 3, major, "v <X64>", 0, 0, 0, "x", False)], HOSTS)
    assert workload.memory_recommendation(hosts).first()["recommended_mb"] == want


def test_memory_for_affined_nodes(spark):
    hosts = frame(spark, [("s", 512, 32 * 2 ** 20, 1804890536, 3, 15, "v <X64>", 0, 0, 0, "VMware", False)], HOSTS)
    nodes = frame(spark, [("s", i, i % 4, i % 4 < 2) for i in range(8)],
                  "server_name string, scheduler_id long, parent_node_id long, is_online boolean")
    assert workload.memory_recommendation(hosts, nodes, numa_affinity=True).first()["recommended_mb"] == 12288
    findings = workload.memory_findings(hosts, nodes).filter("check = 'Memory_issues_MinServerMem'")
    assert "not set in a VM" in findings.first()["deviation"]


# -- logs, events, security ---------------------------------------------------------------------

LOG = "server_name string, log_id long, line_no long, log_date timestamp_ntz, spid string, log_msg string"


def test_error_log(spark):
    texts = ["Error: 823, Severity: 24.", "error: 823 has no comma", "Error: abc, x", "DEADLOCK and stack dump", "quiet", None]
    log = frame(spark, [("s", 0, i, at("2024-01-30 00:00:00"), "spid1", t) for i, t in enumerate(texts)], LOG)
    assert logs.errorlog_since(log, NOW, 1, "day").count() == 0
    assert logs.errorlog_since(log, NOW, 2, "day").count() == 6
    scan = logs.errorlog_scan(log)
    assert rows(scan, "line_no", "phrase") == [(0, "Error:"), (1, "Error:"), (2, "Error:"), (3, "deadlock"), (3, "stack dump")]
    messages = frame(spark, [(823, 1033, "The %ls of %d%s"), (823, 1036, "non")], "message_id long, language_id long, text string")
    got = logs.errorlog_summary(scan, messages)
    assert rows(got, "logged_message", "error_number", "error_count", "look_for_message_example") == [
        ("DEADLOCK and stack dump", None, 2, ""), ("Error: 823, Severity: 24.", "823", 1, "The % of %"),
        ("Error: abc, x", None, 1, ""), ("error: 823 has no comma", None, 1, "")]
    servers = frame(spark, [("s",), ("t",)], "server_name string")
    assert rows(logs.errorlog_finding(servers, scan), "server_name", "deviation") == [
        ("s", "[WARNING: Errorlog contains important messages.]"), ("t", "[OK]")]


def test_spn_findings(spark):
    lines = "server_name string, line long, output string"
    accounts = frame(spark, [("s", 1, "Registered names:"), ("s", 2, "\tMSSQLSvc/HOST1.corp:143"), ("s", 3, "\tMSSQLSvc/HOST2.corp:1433"),
                             ("t", 1, "nothing")], lines)
    duplicates = frame(spark, [
        ("s", 1, "MSSQLSvc/HOST1.corp:1433 is registered on these accounts:"), ("s", 2, "\tCN=a"), ("s", 3, None),
        ("s", 4, "MSSQLSvc/HOST2.corp:1433 is registered on these accounts:"), ("s", 5, "\tCN=b"), ("s", 6, "\tCN=c"), ("s", 7, None)], lines)
    machines = frame(spark, [("s", "HOST1"), ("t", "HOST9")], "server_name string, machine_name string")
    got = logs.spn_findings(accounts, duplicates, machines)
    assert rows(got.filter("server_name = 's'"), "check", "spn", "information") == [
        ("Dup_MSSQLSvc_SPNs_Acct", "[MSSQLSvc/HOST2.corp:1433]", "[CN=b]"), ("Dup_MSSQLSvc_SPNs_Acct", "[MSSQLSvc/HOST2.corp:1433]", "[CN=c]"),
        ("Dup_MSSQLSvc_SPNs_Acct_CurrServer", None, None), ("MSSQLSvc_SPNs_SvcAcct", "[MSSQLSvc/HOST2.corp:1433]", None),
        ("MSSQLSvc_SPNs_SvcAcct_CurrServer", "[MSSQLSvc/HOST1.corp:143]", None)]
    assert got.filter("server_name = 't'").count() == 3


def test_alert_matches_by_both_kinds_of_rule(spark):
    events = frame(spark, [("s", 1, at(NOW), 823, 24), ("s", 2, at(NOW), 1, 15), ("s", 3, at(NOW), 825, 10)],
                   "server_name string, event_id long, event_time timestamp_ntz, error_number long, severity long")
    assert rows(logs.alert_matches(events), "event_id", "rule") == [(1, "Error Number 823"), (1, "Severity 024"), (3, "Error Number 825")]


def test_health_events_without_the_wanted_node(spark):
    xe = frame(spark, [("s", '<event name="error_reported" timestamp="2024-01-31T11:00:00.000Z"></event>'), ("s", "broken"),
                       ("s", '<event name="error_reported" timestamp="2024-01-30T11:59:59.999Z"/>')], "server_name string, event_xml string")
    got = availability.ha_errors(xe, NOW)
    assert rows(got, "timestamp", "error_number") == [(at("2024-01-31 11:00:00"), None)]
    assert availability.ha_errors(xe, NOW, utc_offset=-1).count() == 1
    assert availability.ha_errors(xe, NOW, hours=48).count() == 2


def test_counter_rate_of_equal_times(spark):
    counters = frame(spark, [("s", " c ", "i", 1, at(NOW), 10), ("s", " c ", "i", 2, at(NOW), 20)],
                     "server_name string, counter_name string, instance_name string, sample_id long, captured_at timestamp_ntz, value long")
    assert rows(availability.counter_rate(counters, "c"), "seconds", "change", "rate_per_second") == [(0, 10, None)]


def test_bad_logins(spark):
    names = "server_name string, login_name string"
    bad = security.bad_logins(frame(spark, [("s", "x"), ("s", "y")], names), frame(spark, [("s", "x")], names))
    assert bad.count() == 2
    logins = frame(spark, [("s", "x", b"\x01"), ("t", "x", b"\x01")], "server_name string, name string, sid binary")
    users = frame(spark, [("s", "d", b"\x01", 5, "ux", True)], "server_name string, database_name string, sid binary, principal_id long, name string, is_login boolean")
    schemas = frame(spark, [("s", "d", 5, 7, "own"), ("s", "d", 5, 20000, "fixed")],
                    "server_name string, database_name string, principal_id long, schema_id long, name string")
    objects = frame(spark, [("s", "d", 99, "o")], "server_name string, database_name string, schema_id long, name string")
    got = security.bad_login_objects(logins, users, schemas, objects, bad)
    assert rows(got, "drop_user_text") == [
        ("use [d]; alter authorization on schema::[fixed] to [fixed]; drop user [ux];",), ("use [d]; drop schema [own]; drop user [ux];",)]
    assert security.orphaned_users(users, logins).count() == 0
    assert security.orphaned_users(users, logins.filter("server_name = 't'")).count() == 1


def test_database_level_grants_are_optional(spark):
    key = "server_name string, database_name string, "
    empty_users = frame(spark, [], key + "sid binary, principal_id long, name string, is_login boolean, has_db_access boolean")
    principals = frame(spark, [], "server_name string, sid binary, name string")
    known = frame(spark, [], "server_name string, name string, owner_sid binary")
    members = frame(spark, [], key + "role_name string, member_name string")
    grants = frame(spark, [("s", "d", 0, 0, "u", "GRANT", "CONNECT"), ("s", "d", 1, 5, "u", "GRANT_WITH_GRANT_OPTION", "SELECT")],
                   key + "class int, major_id long, grantee_name string, state_desc string, permission_name string")
    objects = frame(spark, [("s", "d", 5, 1, "o")], key + "object_id long, schema_id long, name string")
    schemas = frame(spark, [("s", "d", 1, "dbo")], key + "schema_id long, name string")
    args = (known, empty_users, principals, members, grants, objects, schemas)
    assert rows(security.permission_script(*args), "extract") == [
        ("EXEC( 'USE d; GRANT  SELECT ON [dbo].[o]  TO [u]  WITH GRANT OPTION'); ",)]
    assert security.permission_script(*args, include_database_level=True).count() == 2
    assert security.permission_script(*args, database="other").count() == 0


def test_index_without_included_columns(spark):
    key = "server_name string, schema_name string, table_name string, index_name string, "
    columns = frame(spark, [("s", "dbo", "t", "i", "b", 2, True, False), ("s", "dbo", "t", "i", "a", 1, False, False)],
                    key + "column_name string, ordinal long, is_descending boolean, is_included boolean")
    flags = "is_unique boolean, type_desc string, is_padded boolean, allow_page_locks boolean, allow_row_locks boolean, no_recompute boolean, " \
            "ignore_dup_key boolean, fill_factor long, is_disabled boolean, is_primary_key boolean, is_unique_constraint boolean, " \
            "filegroup_name string, type int"
    indexes = frame(spark, [("s", "dbo", "t", "i", True, "NONCLUSTERED", False, True, True, False, False, 90, False, False, False, "PRIMARY", 2)],
                    key + flags)
    got = inventory.index_ddl(indexes, columns).first()
    assert got["create_text"].startswith("CREATE UNIQUE NONCLUSTERED INDEX [i] ON [dbo].[t](a ASC, b DESC) \rWITH (PAD_INDEX = OFF")
    assert got["disable_text"] == ""


def test_lists(spark):
    df = frame(spark, [(1, "a.b..c"), (2, ""), (3, None)], "id long, v string")
    assert rows(lists.split_list(df, "v", "."), "id", "item_no", "item") == [
        (1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, "c"), (2, 1, "")]
    stamped = frame(spark, [(at("2019-12-31 22:25:59"),)], "t timestamp_ntz")
    got = lists.timestamp_formats(stamped, "t").first()
    assert (got["style_112"], got["month_year"], got["weekday"], got["hours_minutes"]) == (
        "20191231", "December, 2019", "Tuesday December 31", "10h, 25m")


def test_row_order_of_input_does_not_matter(spark):
    data = [one(i, f"2024-01-{1 + i % 28:02d} 0{i % 9}:00:00", db=f"d{i % 3}", kind="DIL"[i % 3]) for i in range(60)]
    forward, backward = backups(spark, *data), backups(spark, *reversed(data))
    for report in (lambda b: backup.backup_frequency(b, NOW), lambda b: backup.backup_size_delta(b), lambda b: backup.latest_by_type(b, NOW)):
        assert rows(report(forward)) == rows(report(backward.repartition(5)))


def test_running_jobs_are_named_before_they_meet_instants(spark):
    from helpers import plan_of
    names = frame(spark, [("s", 1, "a"), ("s", 2, "b"), ("t", 1, "c")], "server_name string, job_id long, name string")
    history = frame(spark, [("s", 1, 0, 20240131, 100, 10000), ("s", 1, 1, 20240131, 100, 10000), ("s", 2, 0, 20240131, 3000, 5), ("t", 1, 0, 20240131, 0, 0),
                            ("s", 9, 0, 20240131, 100, 10000)],
                    "server_name string, job_id long, step_id int, run_date long, run_time long, run_duration long")
    instants = frame(spark, [("s", at("2024-01-31 00:30:05")), ("s", at("2024-01-31 01:01:00")), ("s", at("2024-01-31 01:01:01")),
                             ("t", at("2024-01-31 00:00:00"))], "server_name string, at timestamp_ntz")
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        got = jobs.jobs_running_at_each(names, history, instants)
        plan = plan_of(got)
        assert [(str(t), j) for t, j in rows(got, "at", "job_name")] == [
            ("2024-01-31 00:00:00", "c"), ("2024-01-31 00:30:05", "a"), ("2024-01-31 00:30:05", "b"), ("2024-01-31 01:01:00", "a")]
    finally:
        spark.conf.unset(key)
    joined = [line for line in plan.splitlines() if "Join" in line]
    assert len(joined) == 2 and "_block" in joined[0]       # the last join makes the result: none of its rows is shuffled
