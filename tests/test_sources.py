"""Readers and writers on small files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import at, frame, rows
from opslens.plans import inventory
from opslens.sources import readers, sinks


def test_read_table_prunes_days(spark, tmp_path):
    data = [("s1", 1, 2, "C:\\x", day) for day in ("2024-01-01", "2024-01-02")]
    df = frame(spark, data, "server_name string, media_set_id long, device_type int, physical_device_name string, day string")
    df.withColumn("captured_date", F.col("day").cast("date")).drop("day").write.partitionBy("captured_date").parquet(
        f"{tmp_path}/backupmediafamily")
    got = readers.read_table(spark, str(tmp_path), "backupmediafamily", since="2024-01-02")
    assert got.count() == 1
    assert len(got.inputFiles()) >= 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(captured_date" in plan
    with pytest.raises(KeyError):
        readers.read_table(spark, str(tmp_path), "nothing")


def test_fleet_goes_on_without_one_server(spark, tmp_path):
    for server in ("a", "c"):
        frame(spark, [(1,)], "v long").write.parquet(f"{tmp_path}/{server}")
    got, errors = readers.read_fleet(spark, ["a", "b", "c"], lambda s, server: s.read.parquet(f"{tmp_path}/{server}"))
    assert rows(got, "server_name", "v") == [("a", 1), ("c", 1)]
    assert rows(errors, "server_name") == [("b",)]
    nothing, errors = readers.read_fleet(spark, ["b"], lambda s, server: s.read.parquet(f"{tmp_path}/{server}"))
    assert nothing is None and errors.count() == 1


def test_event_files(spark, tmp_path):
    event = ('<event name="error_reported" timestamp="2024-01-0{d}T00:00:00.000Z"><data name="error_number"><value>{n}</value>'
             '<text></text></data></event>')
    for d in (1, 2):
        (tmp_path / f"health_{d}.xml").write_text("<events>" + event.format(d=d, n=d) + event.format(d=d, n=9) + "</events>")
    got = readers.read_xe(spark, f"{tmp_path}/health_*.xml")
    from opslens.functions import xmls
    assert rows(got.select(F.dayofmonth("event_time").alias("d"), xmls.named(F.col("event"), "error_number").alias("n"))) == [
        (1, "1"), (1, "9"), (2, "2"), (2, "9")]
    (tmp_path / "ring.xml").write_text("<RingBufferTarget truncated='0'>" + event.format(d=3, n=7) + "</RingBufferTarget>")
    assert readers.read_ring_buffer(spark, f"{tmp_path}/ring.xml").count() == 1


def test_readers_feed_the_reports(spark, tmp_path):
    from opslens.plans import availability, logs
    event = ('<event name="{name}" timestamp="2024-01-31T10:00:0{n}.000Z"><data name="error_number"><value>{n}</value></data>'
             '<data name="message"><value>error_reported here</value></data></event>')
    for server, name in (("SRV1", "error_reported"), ("SRV2", "wait_info")):
        folder = tmp_path / f"server_name={server}"
        folder.mkdir()
        (folder / "health.xml").write_text("<events>" + event.format(name=name, n=3) + event.format(name=name, n=4) + "</events>")
    xe = readers.read_xe(spark, f"{tmp_path}/*/health.xml")
    assert rows(availability.ha_errors(xe, "2024-01-31 12:00:00"), "server_name", "error_number") == [("SRV1", 3), ("SRV1", 4)]
    assert rows(logs.health_error_detail(xe), "server_name", "error_number") == [("SRV1", 3), ("SRV1", 4)]
    servers = frame(spark, [("SRV1",), ("SRV2",)], "server_name string")
    assert rows(logs.health_finding(servers, xe), "server_name", "deviation") == [
        ("SRV1", "[WARNING: System Health Session contains important messages.]"), ("SRV2", "[OK]")]
    target = "<RingBufferTarget>" + event.format(name="wait_info", n=1) + "</RingBufferTarget>"
    targets = frame(spark, [("SRV2", target)], "server_name string, target_data string")
    assert logs.health_finding(servers, targets).filter("deviation <> '[OK]'").count() == 0


def test_error_logs_with_archives(spark, tmp_path):
    import os
    (tmp_path / "ERRORLOG").write_text("2024-01-31 10:00:00.12 spid5s      Error: 823, Severity: 24.\n\tcontinued\n")
    (tmp_path / "ERRORLOG.2").write_text("2024-01-01 09:00:00 Logon       Login failed\n")
    os.utime(tmp_path / "ERRORLOG.2", (0, 1_000_000_000))
    got = readers.read_errorlog(spark, str(tmp_path))
    assert rows(got, "log_id", "spid", "log_msg") == [
        (0, "spid5s", "Error: 823, Severity: 24."), (0, "spid5s", "\tcontinued"), (2, "Logon", "Login failed")]
    assert rows(got.filter("log_id = 0").select(F.col("log_date").cast("string"), "line_no")) == [("2024-01-31 10:00:00.12", 0), ("2024-01-31 10:00:00.12", 1)]
    assert rows(readers.read_errorlog(spark, str(tmp_path), since="2020-01-01 00:00:00"), "log_id") == [(0,), (0,)]


def test_counter_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        '"(PDH-CSV 4.0)","\\\\SRV1\\Memory\\Available MBytes","\\\\SRV1\\PhysicalDisk(0 C:)\\Disk Reads/sec"\n'
        '"01/31/2024 10:00:00.500","512"," "\n"01/31/2024 10:00:05.500","500","2.5"\n')
    got = readers.read_counters(spark, str(tmp_path))
    assert rows(got.filter("value is not null"), "server_name", "counter_name", "instance_name", "value") == [
        ("SRV1", "Memory\\Available MBytes", "", 500.0), ("SRV1", "Memory\\Available MBytes", "", 512.0),
        ("SRV1", "PhysicalDisk\\Disk Reads/sec", "0 C:", 2.5)]


def test_a_server_that_fails_at_run_time_is_a_row(spark):
    def fetch(server):
        yield {"v": 1, "w": "a"}
        if server == "bad":
            raise OSError("gone away")
        yield {"v": 2, "w": None}

    got, failed = readers.fetch_fleet(spark, ["s1", "bad", "s2"], fetch, "v long, w string")
    assert rows(got, "server_name", "v") == [("s1", 1), ("s1", 2), ("s2", 1), ("s2", 2)]
    assert rows(failed) == [("bad", "gone away")]


def test_counter_files_keep_their_own_header(spark, tmp_path):
    for server in ("SRVA", "SRVB"):
        (tmp_path / f"{server}.csv").write_text(
            f'"(PDH-CSV 4.0)","\\\\{server}\\Memory\\Available MBytes"\n"01/31/2024 10:00:00.500","512"\n')
    got = readers.read_counters(spark, str(tmp_path))
    assert rows(got, "server_name", "value") == [("SRVA", 512.0), ("SRVB", 512.0)]


def test_a_second_header_names_what_follows(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        '"(PDH-CSV 4.0)","\\\\S\\Memory\\Free"\n"01/31/2024 10:00:00.000","1"\n"01/31/2024 10:00:05.000","2"\n'
        '"(PDH-CSV 4.0)","\\\\S\\Memory\\Free","\\\\S\\Disk(0)\\Reads"\n"01/31/2024 10:00:10.000","3","4"\n')
    got = readers.read_counters(spark, str(tmp_path))
    assert rows(got, "counter_name", "value") == [("Disk\\Reads", 4.0), ("Memory\\Free", 1.0), ("Memory\\Free", 2.0), ("Memory\\Free", 3.0)]


def test_printed_output_feeds_the_reports(spark):
    lines = frame(spark, [("/x/server_name=S1/out.txt", 0, "a"), ("/x/server_name=S1/out.txt", 1, "  ")], "file string, line_no long, line string")
    assert rows(readers.printed_output(lines)) == [("S1", 0, "a"), ("S1", 1, None)]


def test_old_events_are_not_parsed(spark):
    from opslens.functions import xmls
    from opslens.plans import availability
    event = '<event name="error_reported" package="x" timestamp="{}"><data name="error_number"><value>5</value></data></event>'
    odd = "<event name='error_reported' timestamp='2024-01-31T09:59:59.999Z'/>"
    texts = [event.format("2024-01-31T10:00:00.000Z"), event.format("2024-01-30T10:00:00.000Z"), "  " + odd, "<?xml version='1.0'?>" + odd, "junk", None]
    xe = frame(spark, [("s", t) for t in texts], "server_name string, event_xml string")
    kept = xe.filter(xmls.maybe_since(F.col("event_xml"), F.expr("TIMESTAMP_NTZ'2024-01-31 10:00:00'")))
    assert [r["event_xml"] for r in kept.collect()] == [texts[0], texts[2], texts[3], "junk"]  # only the quotes of the server's own are read
    for offset, hours, want in ((0, 2, 1), (1, 2, 1), (0, 27, 2), (-3, 29, 1), (3, 21, 2)):
        got = availability.ha_errors(xe.filter("event_xml like '<event%'"), "2024-01-31 12:00:00", hours + offset, offset)
        assert got.count() == want, (offset, hours)


def test_server_of_a_path(spark, tmp_path):
    folder = tmp_path / "server_name=SRV7"
    folder.mkdir()
    (folder / "ERRORLOG").write_text("2024-01-31 10:00:00.12 spid5s      one\n\ttwo\n")
    got = readers.read_errorlog(spark, str(folder))
    assert rows(got, "server_name", "log_msg") == [("SRV7", "\ttwo"), ("SRV7", "one")]
    from opslens.plans import logs
    assert logs.errorlog_since(got, "2024-01-31 12:00:00", 1).count() == 2


def test_file_inventory_and_lines(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bak").write_bytes(b"12345")
    (tmp_path / "d" / "b.txt").write_bytes(b"1")
    got = readers.read_file_inventory(spark, str(tmp_path / "d"), "*.bak")
    assert rows(got, "length") == [(5,)]
    lines = [("f", i, t) for i, t in enumerate(["; note", "lone", "[One]", " srv1 ", "", "[One\\Two]", "srv2", "[x]", "#c", "[bad one]"])]
    frame(spark, lines, "file string, line_no long, line string").write.parquet(f"{tmp_path}/lines")
    registry = inventory.server_registry(readers.read_lines(spark, f"{tmp_path}/lines"))
    assert [r[1:] for r in sorted(tuple(r) for r in registry.select("line_no", "parent_folder", "type", "value").collect())] == [
        (".", "Registration", "lone"), (".", "Directory", "One"), ("One", "Registration", "srv1"),
        ("One", "Directory", "Two"), ("One\\Two", "Registration", "srv2")]


def test_directory_listing(spark):
    text = [" Volume in drive D is X", "", " Directory of D:\\a", "10/08/2013  02:37 PM            228253 b c.mdf",
            "               1 File(s)         228253 bytes", " Directory of D:\\z", "01/01/2024  12:00 AM 5 q.ldf"]
    lines = frame(spark, [("f", i, t) for i, t in enumerate(text)], "file string, line_no long, line string")
    got = readers.directory_listing(lines)
    assert rows(got, "path", "length", "modified") == [
        ("D:\\a\\b c.mdf", 228253, at("2013-10-08 14:37:00")), ("D:\\z\\q.ldf", 5, at("2024-01-01 00:00:00"))]


def test_trace_folder_in_one_scan(spark, tmp_path):
    from opslens.sources.schemas import schema_of
    for event in (1, 2):
        spark.range(1).selectExpr("'s' as server_name", f"{event}L as event_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    got = readers.read_trace(spark, f"{tmp_path}/t")
    assert got.count() == 2 and "trace_file" in got.columns and len(got.columns) == len(schema_of("trace").split(",")) + 1


def test_queries_and_constants(spark):
    df = readers.values_df(spark, [(1, "a"), (2, "b")], "id long, n string")
    assert rows(readers.run_sql(spark, "select n from {t} where id = :id", {"id": 2}, t=df)) == [("b",)]
    assert sinks.scalar(df.filter("id = 1").select("n")) == "a"
    assert sinks.scalar(df.filter("id = 3")) is None
    assert rows(readers.per_database(df.withColumn("database_name", F.col("n")), "a"), "id") == [(1,)]


def test_writers(spark, tmp_path):
    df = frame(spark, [(1, "a,b"), (2, None)], "id long, n string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert rows(spark.read.option("header", True).schema("id long, n string").csv(f"{tmp_path}/csv")) == rows(df)
    log = f"{tmp_path}/log"
    assert sinks.read_log(spark, log, df.schema).count() == 0
    assert [sinks.append_log(df, log, b, {"most": F.max("id")}) for b in ("a b", 2, "a b")] == [True, True, False]
    assert rows(sinks.read_log(spark, log), "batch", "id") == [("2", 1), ("2", 2), ("a b", 1), ("a b", 2)]
    assert rows(sinks.read_ledger(spark, log), "rows", "most") == [(2, 2), (2, 2)]
    df.limit(1).write.parquet(f"{log}/rows/batch=3")  # a writer that died before it published
    assert sinks.read_log(spark, log).count() == 4
    assert sinks.append_log(df, log, 3) and rows(sinks.read_log(spark, log, df.schema, "string"), "batch", "id")[2:4] == [("3", 1), ("3", 2)]
    assert "<id>1</id>" in sinks.to_xml_rows(df).filter("id = 1").first()["xml"]
    assert rows(sinks.materialize(df)) == rows(df)
    assert rows(sinks.materialize(df, f"{tmp_path}/m")) == rows(df)
    assert rows(sinks.scratch_table(df, "t")) == rows(df)


def test_snapshots_keep_two_weeks(spark):
    df = frame(spark, [("s", 1)], "server_name string, v long")
    spark.sql("drop table if exists snaps")
    assert sinks.append_snapshot(df, "snaps", "2024-01-01 08:00:00") == []
    assert sinks.append_snapshot(df, "snaps", datetime(2024, 1, 15, 8)) == []
    assert sinks.append_snapshot(df, "snaps", "2024-01-16 08:00:00") == ["2024-01-01"]
    assert rows(spark.table("snaps").select(F.col("captured_date").cast("string"))) == [("2024-01-15",), ("2024-01-16",)]
    other = frame(spark, [("t", 5), ("t", 6)], "server_name string, v long")
    sinks.append_snapshot(other, "snaps", "2024-01-16 08:00:00")     # another server, same moment
    sinks.append_snapshot(df, "snaps", "2024-01-16 08:00:00")        # the first one again
    assert rows(spark.table("snaps"), "server_name", "v") == [("s", 1), ("s", 1), ("t", 5), ("t", 6)]
    spark.sql("drop table snaps")


def test_cluster_needs_a_shared_folder(monkeypatch):
    from opslens import session

    class Context:
        master = "yarn"

    class Conf:
        def get(self, key, default=None):
            return default

    class Spark:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_folder(Spark())


def snapshots(spark, table, captures, schema):
    spark.sql(f"drop table if exists {table}")
    for moment, data, servers in captures:
        sinks.append_snapshot(frame(spark, data, schema), table, moment, servers=servers)


def test_state_is_read_from_the_newest_whole_capture(spark):
    from opslens.operators import captures
    eight, nine, ten = (f"2024-01-0{d} 10:00:00" for d in (1, 2, 3))
    snapshots(spark, "states", [(eight, [("a b", 1), ("s", 2)], None), (nine, [("a b", 3), ("s", 4)], None), (ten, [("s", 5)], ["s", "empty'd+"])],
              "server_name string, v long")
    snapshots(spark, "others", [(eight, [("a b", 10), ("s", 20)], None), (nine, [("s", 40)], ["a b", "s"]), (ten, [("s", 50), ("empty'd+", 60)], None)],
              "server_name string, w long")
    index = rows(captures.capture_index(spark, "states").select("capture", "server_name"))
    assert index == [("20240101T100000.000000", "a b"), ("20240101T100000.000000", "s"), ("20240102T100000.000000", "a b"),
                     ("20240102T100000.000000", "s"), ("20240103T100000.000000", "empty'd+"), ("20240103T100000.000000", "s")]
    both = {"x": "states", "y": "others"}
    now = captures.state_as_of(spark, both, "2024-01-03 12:00:00")
    # "a b" was last captured on the second, when it had no rows in one of the tables; a server without rows is no older state
    assert rows(now["x"], "server_name", "v") == [("a b", 3), ("s", 5)]
    assert rows(now["y"], "server_name", "w") == [("empty'd+", 60), ("s", 50)]
    assert rows(now.captures.select("server_name", F.col("captured_at").cast("string"))) == [
        ("empty'd+", ten), ("a b", "2024-01-02 10:00:00"), ("s", ten)]
    assert now["x"].columns == ["v", "server_name"]
    before = captures.state_as_of(spark, both, "2024-01-02 09:59:59")
    assert rows(before["x"], "server_name", "v") == [("a b", 1), ("s", 2)]
    assert rows(captures.state_as_of(spark, both, "2024-01-03 12:00:00", within_days=1)["x"], "server_name", "v") == [("s", 5)]
    assert captures.state_as_of(spark, both, "2023-01-01")["x"].count() == 0
    snapshots(spark, "partial", [(nine, [("s", 1), ("t", 1)], None)], "server_name string, u long")
    mixed = captures.state_as_of(spark, {"x": "states", "z": "partial"}, "2024-01-03 12:00:00")
    assert rows(mixed["x"], "server_name", "v") == [("s", 4)] and rows(mixed["z"], "server_name", "u") == [("s", 1)]
    for table in ("states", "others", "partial"):
        spark.sql(f"drop table {table}")


def test_state_reports_open_only_their_capture(spark):
    from opslens.operators import captures
    from helpers import plan_of
    days = [(f"2024-01-{d:02d} 10:00:00", [("s", d), ("t", d)], None) for d in range(1, 6)]
    snapshots(spark, "daily", days, "server_name string, v long")
    state = captures.state_as_of(spark, {"d": "daily"}, "2024-01-04 00:00:00")
    scan = next(line for line in plan_of(state["d"]).split("\n") if "FileScan" in line)
    filters = scan[scan.index("PartitionFilters"):]
    assert "captured_date" in filters and "= 2024-01-03" in filters and "(capt" in filters
    read = state["d"].select(F.input_file_name()).distinct().collect()
    assert len(read) == 2 and all("capture=20240103T100000.000000" in r[0] for r in read)
    spark.sql("drop table daily")


def test_a_fleet_is_captured_in_few_files(spark):
    from opslens.operators import captures
    fleet = [(f"srv_{i}", i) for i in range(200)] + [(None, -1)]
    snapshots(spark, "fleet", [("2024-01-01 10:00:00", fleet, None)], "server_name string, v long")
    assert spark.sql("show partitions fleet").count() == 1 and len(spark.table("fleet").inputFiles()) <= spark.sparkContext.defaultParallelism
    assert captures.capture_index(spark, "fleet").count() == 201
    state = captures.state_as_of(spark, {"f": "fleet"}, "2024-01-01 12:00:00")
    assert rows(state["f"], "server_name", "v") == sorted(fleet, key=repr)
    spark.sql("drop table fleet")


def test_servers_captured_again_with_others_replace_only_their_rows(spark):
    from opslens.operators import captures
    moment = "2024-01-05 10:00:00"
    days = [("2023-12-20 10:00:00", [("s", 0)], None), (moment, [("s", 1), ("t", 1), (None, 1)], ["e"])]
    snapshots(spark, "mixed", days, "server_name string, v long")

    def again(data, servers=None):
        sinks.append_snapshot(frame(spark, data, "server_name string, v long"), "mixed", moment, servers=servers)
        return rows(spark.table("mixed"), "server_name", "v")

    assert again([("t", 2), ("t", 3), ("u", 2)]) == [("s", 1), ("t", 2), ("t", 3), ("u", 2), (None, 1)]
    assert again([(None, 4), ("e", 4)]) == [("e", 4), ("s", 1), ("t", 2), ("t", 3), ("u", 2), (None, 4)]
    assert again([("u", 5)], ["s"]) == [("e", 4), ("s", 1), ("t", 2), ("t", 3), ("u", 5), (None, 4)]
    assert again([("s", 6), ("t", 6), (None, 6)]) == again([("s", 6), ("t", 6), (None, 6)]) == [("e", 4), ("s", 6), ("t", 6), ("u", 5), (None, 6)]
    assert spark.sql("show partitions mixed").count() == 3  # emptied sets are dropped, and so is the day past its retention
    state = captures.state_as_of(spark, {"m": "mixed"}, "2024-01-05 12:00:00")
    assert rows(state["m"], "server_name", "v") == [("e", 4), ("s", 6), ("t", 6), ("u", 5), (None, 6)]
    assert rows(state.captures, "server_name") == [("e",), ("s",), ("t",), ("u",), (None,)]
    spark.sql("drop table mixed")
