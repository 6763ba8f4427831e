"""Streams give what their batch twins give, in one go, in parts, and after a restart."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import at, frame, rows
from opslens.plans import availability, logs, workload
from opslens.streaming import jobs

START = at("2024-01-01 00:00:00")
SAMPLES = "server_name string, job_id long, sample_id long, sampled_at timestamp_ntz, percent_complete double"
MATCHES = ("server_name string, rule string, event_id long, event_time timestamp_ntz, error_number long, "
           "severity long")
COUNTERS = ("server_name string, counter_name string, instance_name string, sample_id long, "
            "captured_at timestamp_ntz, value long")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A stateful step starts a worker for each partition and micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def write_parts(spark, data, schema, folder, parts):
    """Rows in time order over several files, as they would arrive."""
    size = -(-len(data) // parts)
    for i in range(parts):
        chunk = data[i * size:(i + 1) * size]
        frame(spark, chunk, schema).coalesce(1).write.mode("append").parquet(folder)


def zoneless(df):
    for field in df.schema.fields:
        if field.dataType.simpleString() == "timestamp":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp_ntz"))
    return df


def through(spark, data, schema, tmp_path, job, parts, restarts=1):
    folder, where = f"{tmp_path}/in", f"{tmp_path}/out"
    size = -(-len(data) // restarts)
    out = None
    for r in range(restarts):
        write_parts(spark, data[r * size:(r + 1) * size], schema, folder, parts)
        out = jobs.run_to_end(job(jobs.read_stream(spark, folder, schema, files_per_batch=1)), folder=where)
    return zoneless(out).drop("batch")


def progress(n=160):
    rng = random.Random(1)
    out, percent = [], {}
    for i in range(n):
        job = rng.randrange(3)
        percent[job] = min(100.0, percent.get(job, 0.0) + rng.choice([0.5, 1.0, 3.0, 25.0]))
        out.append(("s", job, i, START + timedelta(seconds=i * 97), percent[job]))
    return out


@pytest.mark.parametrize("parts, restarts", [(1, 1), (4, 1), (2, 2)])
def test_milestones(spark, tmp_path, parts, restarts):
    data = progress()
    got = through(spark, data, SAMPLES, tmp_path, jobs.milestones, parts, restarts)
    want = workload.progress_milestones(frame(spark, data, SAMPLES))
    columns = ["server_name", "job_id", "milestone", "sampled_at", "percent_complete", "announced"]
    assert rows(got, *columns) == rows(want.withColumn("milestone", F.col("milestone").cast("long")), *columns)
    assert want.count() > 3


def test_milestone_skipped_when_a_higher_one_came_first(spark):
    data = [("s", 1, 1, START, 5.0), ("s", 1, 2, START + timedelta(minutes=1), 60.0),
            ("s", 1, 3, START + timedelta(minutes=2), 20.0), ("s", 1, 4, START + timedelta(minutes=5), 85.0),
            ("s", 1, 5, START + timedelta(minutes=30), 96.0), ("s", 1, 6, START + timedelta(minutes=31), 100.0)]
    got = workload.progress_milestones(frame(spark, data, SAMPLES))
    assert rows(got, "milestone", "announced") == [(50, True), (80, False), (95, True)]


@pytest.mark.parametrize("parts, restarts", [(1, 1), (5, 1), (2, 3)])
def test_alert_responses(spark, tmp_path, parts, restarts):
    rng = random.Random(2)
    data = [("s", rng.choice(["r1", "r2"]), i, START + timedelta(seconds=i * rng.choice([7, 8])), 823, 16) for i in range(120)]
    data.sort(key=lambda r: (r[3], r[2]))
    got = through(spark, data, MATCHES, tmp_path, jobs.alert_responses, parts, restarts)
    from opslens.operators import greedy
    want = greedy.keep_gap(frame(spark, data, MATCHES), ["server_name", "rule"], "event_time", "event_id", 60)
    assert rows(got, "rule", "event_id") == rows(want, "rule", "event_id")


def heartbeat(columns, days=30):
    """A sample of a key of its own, far ahead: the watermark passes all others."""
    return tuple({"captured_at": START + timedelta(days=days), "sample_id": -1, "value": 0}.get(c, "beat") for c in columns)


@pytest.mark.parametrize("parts, restarts, mixed", [(1, 1, False), (3, 2, False), (8, 1, True)])
def test_counter_rates(spark, tmp_path, parts, restarts, mixed):
    rng = random.Random(3)
    data = [("s", "c", rng.choice("xy"), i, START + timedelta(seconds=5 * (i // 2)), 1000 * i * i) for i in range(80)]
    want = availability.counter_rate(frame(spark, data, COUNTERS))
    if mixed:
        rng.shuffle(data)
    data += [heartbeat([c.split()[0] for c in COUNTERS.split(", ")])] * restarts
    got = through(spark, data, COUNTERS, tmp_path, jobs.counter_rates, parts, restarts).filter("server_name = 's'")
    columns = ["instance_name", "sample_id", "seconds", "change", "rate_per_second"]
    assert rows(got, *columns) == rows(want, *columns)


def test_milestones_go_on_from_a_history(spark, tmp_path):
    data = progress(200)
    want = workload.progress_milestones(frame(spark, data, SAMPLES)).withColumn("milestone", F.col("milestone").cast("long"))
    old, new = data[:90], data[90:]
    before = workload.progress_milestones(frame(spark, old, SAMPLES)).withColumn("milestone", F.col("milestone").cast("long"))
    history = jobs.milestone_history(before)
    assert before.count() > 1
    after = through(spark, new, SAMPLES, tmp_path, lambda s: jobs.milestones(s, history), 3, 2)
    columns = ["server_name", "job_id", "milestone", "sampled_at", "percent_complete", "announced"]
    assert rows(before.select(*columns).unionByName(after.select(*columns))) == rows(want.select(*columns))


def test_changed_rules_are_taken_up(spark, tmp_path):
    events = "server_name string, event_id long, event_time timestamp_ntz, error_number long, severity long"
    day = [("s", i, START + timedelta(seconds=40 * i), 823 if i % 2 else 9, 3) for i in range(20)]
    rules = "rule string, message_id long, rule_severity long"
    seen = {}
    for n, (part, own) in enumerate([(day[:10], [("a", 823, 0)]), (day[10:], [("a", 823, 0), ("b", 9, 0)])]):
        write_parts(spark, part, events, f"{tmp_path}/in", 1)
        stream = jobs.read_stream(spark, f"{tmp_path}/in", events)
        out = jobs.run_to_end(jobs.rule_responses(stream, frame(spark, own, rules), 100), folder=f"{tmp_path}/out")
    for r in out.collect():
        seen.setdefault(r["rule"], []).append(r["event_id"])
    assert sorted(seen["a"]) == [1, 5, 9, 13, 17] and sorted(seen["b"]) == [10, 14, 18]


def test_failing_queries_are_captured_once(spark, tmp_path):
    schema = "error_number long, severity long"
    data = [(17830, 20), (208, 16), (50000, 10), (823, 24)]
    got = through(spark, data, schema, tmp_path, jobs.failing_queries, 2, 2)
    assert rows(got, "error_number") == [(208,), (823,)]


def test_windows_count_everything_once(spark, tmp_path):
    schema = "k string, ts timestamp_ntz"
    data = [("a", START + timedelta(minutes=i)) for i in range(100)]
    write_parts(spark, data, schema, f"{tmp_path}/in", 4)
    stream = jobs.read_stream(spark, f"{tmp_path}/in", schema, files_per_batch=1)
    counted = jobs.event_counts(stream, ["k"], "ts", "30 minutes")
    got = jobs.newest_per_key(jobs.run_to_end(counted, "update", f"{tmp_path}/out"), ["window_start", "window_end", "k"])
    assert sorted(r["n"] for r in got.collect()) == [10, 30, 30, 30]


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "k string, ts timestamp_ntz"
    early, late = START, START + timedelta(hours=5)
    for i, moment in enumerate([early, late, late + timedelta(minutes=1), early]):
        frame(spark, [("a", moment)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.read_stream(spark, f"{tmp_path}/in", schema)
        counted = jobs.event_counts(stream, ["k"], "ts", "30 minutes")
        out = jobs.run_to_end(counted, "update", f"{tmp_path}/out")
    got = jobs.newest_per_key(out, ["window_start", "window_end", "k"])
    assert rows(got, "n") == [(1,), (2,)]


@pytest.mark.parametrize("slide", [None, "10 minutes"])
def test_late_rows_are_counted_apart(spark, tmp_path, slide):
    rng = random.Random(4)
    data = [("ab"[i % 2], START + timedelta(minutes=rng.randrange(0, 900))) for i in range(200)]
    write_parts(spark, data, "k string, ts timestamp_ntz", f"{tmp_path}/in", 5)
    stream = jobs.read_stream(spark, f"{tmp_path}/in", "k string, ts timestamp_ntz", files_per_batch=1)
    for _ in range(2):  # a second start finds nothing new
        jobs.counts_with_late(stream, ["k"], "ts", "30 minutes", f"{tmp_path}/out", slide, "1 hour").awaitTermination()
    got = jobs.corrected_counts(spark, f"{tmp_path}/out", ["k"])
    whole = jobs.event_counts(frame(spark, data, "k string, ts timestamp_ntz"), ["k"], "ts", "30 minutes", slide)
    assert rows(got, "window_start", "k", "n") == rows(whole, "window_start", "k", "n")
    late, newest = 0, None
    for i in range(5):
        part = data[40 * i:40 * i + 40]
        late += sum(newest is not None and t < newest - timedelta(hours=1) for _, t in part)
        newest = max([t for _, t in part] + ([newest] if newest else []))
    assert late > 20 and got.agg(F.sum("late")).first()[0] == late * (3 if slide else 1)
    assert got.filter("counted + late <> n").count() == 0


def test_outages_and_duplicates(spark, tmp_path):
    schema = "server_name string, ts timestamp_ntz"
    minutes = [0, 10, 39, 80, 81, 200]
    write_parts(spark, [("s", START + timedelta(minutes=m)) for m in minutes] + [("beat", START + timedelta(days=9))], schema, f"{tmp_path}/in", 1)
    stream = jobs.read_stream(spark, f"{tmp_path}/in", schema)
    out = jobs.run_to_end(jobs.outages(stream, ["server_name"], "ts"), folder=f"{tmp_path}/out")
    assert rows(out.filter("server_name = 's'"), "failures") == [(1,), (2,), (3,)]

    doubled = [("a", START), ("a", START + timedelta(minutes=5)), ("b", START)]
    got = through(spark, doubled, schema, tmp_path / "dup",
                  lambda s: jobs.suppress_duplicates(s, ["server_name"], "ts"), 3)
    assert rows(got, "server_name") == [("a",), ("b",)]


@pytest.mark.parametrize("parts", [1, 7])
def test_duplicates_do_not_depend_on_the_batches(spark, tmp_path, parts):
    moments = [("ab"[i % 2], START + timedelta(minutes=17 * i * (1 + i % 5))) for i in range(60)]
    moments += [("a", START), ("c", START + timedelta(minutes=1)), ("c", START + timedelta(minutes=61))]
    moments.sort(key=lambda m: m[1])
    last, want = {}, []
    for key, moment in moments:
        if key not in last or moment - last[key] > timedelta(hours=1):
            want.append((key, moment))
        last[key] = moment
    got = through(spark, moments, "server_name string, ts timestamp_ntz", tmp_path / str(parts),
                  lambda s: jobs.suppress_duplicates(s, ["server_name"], "ts"), parts)
    assert rows(got, "server_name", "ts") == sorted(want, key=repr)


def test_probe_failures(spark):
    probes = frame(spark, [("s1", START, True), ("s2", START, False)], "server_name string, probed_at timestamp_ntz, answered boolean")
    assert rows(logs.probe_failures(probes), "line") == [("s2 : 2024-01-01 00:00:00 - Request Timed Out",)]


def test_a_hot_server_sends_outages_not_failures(spark, tmp_path):
    schema = "server_name string, ts timestamp_ntz"
    data = [("hot", START + timedelta(seconds=i)) for i in range(4000)] + [("beat", START + timedelta(days=9))]
    write_parts(spark, data, schema, f"{tmp_path}/in", 2)
    stream = jobs.read_stream(spark, f"{tmp_path}/in", schema)
    spark.conf.set(jobs.MERGE_SESSIONS, "true")
    query = jobs.start(jobs.outages(stream, ["server_name"], "ts"), f"{tmp_path}/out")
    query.awaitTermination()
    assert any(p.stateOperators[0].numRowsUpdated and p.stateOperators[0].numRowsUpdated < 10 for p in query.recentProgress)
    out = jobs.results(spark, jobs.outages(stream, ["server_name"], "ts"), f"{tmp_path}/out")
    assert rows(out.filter("server_name = 'hot'"), "failures") == [(4000,)]


def test_duplicates_of_many_keys_share_their_state(spark, tmp_path):
    from opslens.streaming import state
    schema = "user long, kind string, ts timestamp_ntz"
    data = [(i, "k", START + timedelta(seconds=i)) for i in range(3000)] + [(7, "k", START + timedelta(minutes=70))]
    write_parts(spark, data, schema, f"{tmp_path}/in", 1)
    rows_of = jobs.suppress_duplicates(jobs.read_stream(spark, f"{tmp_path}/in", schema), ["user", "kind"], "ts")
    query = jobs.start(rows_of, f"{tmp_path}/out")
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= state.LOTS
    assert jobs.results(spark, rows_of, f"{tmp_path}/out").count() == 3001


def test_duplicates_are_equal_in_all_their_keys(spark, tmp_path):
    keys = [("a", "b:c"), ("a:b", "c"), ("ab", "c"), ("a", None), (None, "a"), (None, None), ("", None), ("", ""), ("-", None), ("1:a", "")]
    rng = random.Random(5)
    data = sorted(((*rng.choice(keys), rng.choice([0.0, -0.0, 1.5]), START + timedelta(seconds=rng.randrange(400000))) for _ in range(400)), key=lambda r: r[3])
    last, want = {}, []
    for *key, moment in data:
        if tuple(key) not in last or moment - last[tuple(key)] > timedelta(hours=1):
            want.append((*key, moment))
        last[tuple(key)] = moment
    got = through(spark, data, "x string, y string, z double, ts timestamp_ntz", tmp_path,
                  lambda s: jobs.suppress_duplicates(s, ["x", "y", "z"], "ts"), 3, restarts=2)
    assert rows(got.withColumn("z", F.col("z") + 0.0), "x", "y", "z", "ts") == sorted(((x, y, z + 0.0, t) for x, y, z, t in want), key=repr)
