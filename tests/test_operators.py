"""Operators against brute force, on uneven keys, ties and nulls."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import at, frame, rows
from opslens.operators import adjacent, changes, forest, greedy, joins, pivots, ranking, textagg

START = at("2024-01-01 00:00:00")


def uneven(seed, n=300):
    """Rows of which a third share one key, with equal times and a null key."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None])
        out.append((key, START + timedelta(hours=rng.randrange(0, 24 * 20)), i, rng.randrange(1000)))
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("width", [3600, 86400, 10 * 86400])
def test_neighbours_equal_brute_force(spark, forward, width):
    data = uneven(1)
    df = frame(spark, data, "k string, t timestamp_ntz, id long, v long")
    step = adjacent.with_next if forward else adjacent.with_previous
    got = step(df, ["k"], ["t", "id"], ["v"], adjacent.time_bucket("t", width))
    want = []
    for key in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]), reverse=forward)
        want += [(*r, before[3] if before else None) for before, r in zip([None, *mine], mine)]
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [3600, 10 * 86400])
def test_earlier_time_is_strictly_earlier(spark, width):
    data = uneven(6)
    got = adjacent.with_earlier_time(frame(spark, data, "k string, t timestamp_ntz, id long, v long"), ["k"], "t",
                                     adjacent.time_bucket("t", width))
    want = [(*r, max((o[1] for o in data if o[0] == r[0] and o[1] < r[1]), default=None)) for r in data]
    assert rows(got) == sorted(want, key=repr)


def test_carry_forward_equals_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.choice("fg"), i, rng.choice(["x", "y", None, None, None])) for i in range(200)]
    df = frame(spark, data, "f string, n long, v string")
    got = adjacent.carry_forward(df, ["f"], "n", F.col("v"), adjacent.line_bucket("n", 7), "c")
    want, last = [], {}
    for f, n, v in sorted(data, key=lambda r: r[1]):
        last[f] = v if v is not None else last.get(f)
        want.append((f, n, v, last[f]))
    assert rows(got) == sorted(want, key=repr)


def test_as_of_previous_is_strictly_earlier(spark):
    left, right = uneven(3, 120), uneven(4, 120)
    schema = "k string, t timestamp_ntz, id long, v long"
    got = adjacent.as_of_previous(frame(spark, left, schema), frame(spark, right, schema), ["k"], "t",
                                  adjacent.time_bucket("t"))
    want = [(*l, max((r[1] for r in right if r[0] == l[0] and r[1] < l[1]), default=None)) for l in left]
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [60, 600, 7200])
def test_keep_gap_equals_greedy(spark, width):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.6 else rng.choice("ab"), START + timedelta(seconds=rng.randrange(0, 5000)), i)
            for i in range(400)]
    df = frame(spark, data, "k string, t timestamp_ntz, id long")
    want = []
    for key in {r[0] for r in data}:
        last = None
        for r in sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2])):
            if last is None or r[1] >= last + timedelta(seconds=60):
                want.append(r)
                last = r[1]
    assert rows(greedy.keep_gap(df, ["k"], "t", "id", 60, width)) == sorted(want, key=repr)


def test_a_burst_in_one_second_keeps_one_row(spark):
    burst = frame(spark, [("hot", START, n) for n in range(2000)] + [("a", START, 1)], "k string, t timestamp_ntz, id int")
    assert rows(greedy.keep_gap(burst, ["k"], "t", "id", 60).select("k", "id")) == [("a", 1), ("hot", 0)]


def test_a_long_interval_takes_few_blocks(spark):
    from opslens.operators import joins
    year = spark.range(1).select(F.size(joins._blocks(F.lit(1_700_000_123), F.lit(1_731_536_129))).alias("n"))
    assert year.first()["n"] <= 64


def test_forest(spark):
    nodes = [("s", 1, None), ("s", 2, 1), ("s", 3, 2), ("s", 4, 3), ("s", 5, 1), ("s", 7, 8), ("s", 8, 7), ("s", 9, 99),
             ("t", 2, None), ("t", 1, 2)]
    got = forest.walk(frame(spark, nodes, "s string, id long, up long"), ["s"], "id", "up", 2)
    assert rows(got, "s", "id", "root", "depth", "path") == [
        ("s", 1, 1, 0, "01"), ("s", 2, 1, 1, "0102"), ("s", 3, 1, 2, "010203"), ("s", 4, 1, 3, "01020304"),
        ("s", 5, 1, 1, "0105"), ("t", 1, 2, 1, "0201"), ("t", 2, 2, 0, "02")]


def test_forest_of_one_deep_chain(spark):
    chain = [("s", i, i - 1 if i else None) for i in range(70)]
    got = forest.walk(frame(spark, chain, "s string, id long, up long"), ["s"], "id", "up", 2)
    assert [r[0] for r in rows(got, "depth")] == sorted(range(70), key=lambda i: repr((i,)))


def test_forest_empty(spark):
    assert forest.walk(frame(spark, [], "s string, id long, up long"), ["s"], "id", "up").count() == 0


def test_latest_rows_ties(spark):
    df = frame(spark, [("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z"), (None, 5, "n")], "k string, o long, v string")
    assert rows(ranking.latest_rows(df, ["k"], [F.desc("o")], ties=True), "v") == [("n",), ("x",), ("y",)]
    assert rows(ranking.latest_rows(df, ["k"], [F.desc("o"), F.asc("v")]), "v") == [("n",), ("x",)]


def test_prefix_join_needs_the_whole_length(spark):
    left = frame(spark, [("s", "ABC", 3), ("s", "AB", 2), ("s", "ABCDEF", 6)], "s string, p string, n long")
    right = frame(spark, [("s", "ABCX"), ("s", "AB"), ("u", "ABC")], "s string, t string")
    got = joins.prefix_join(left, right, ["s"], "p", "n", "t")
    assert rows(got, "p", "t") == [("AB", "AB"), ("AB", "ABCX"), ("ABC", "ABCX")]


def test_covering_join_includes_both_ends(spark):
    spans = frame(spark, [("s", 1, at("2024-01-01 23:00:00"), at("2024-01-02 01:00:00"))],
                  "s string, id long, a timestamp_ntz, b timestamp_ntz")
    times = ["2024-01-01 23:00:00", "2024-01-02 00:30:00", "2024-01-02 01:00:00", "2024-01-02 01:00:01"]
    points = frame(spark, [("s", at(t)) for t in times], "s string, at timestamp_ntz")
    got = joins.covering_join(spans, points, "a", "b", "at", ["s"])
    assert [str(r[0]) for r in rows(got, "at")] == times[:3]


def test_covering_join_equals_all_pairs(spark):
    rng = random.Random(9)
    spans = []
    for i in range(60):
        a = START + timedelta(seconds=rng.randrange(0, 20000), microseconds=rng.randrange(10 ** 6))
        spans.append(("hot" if i % 3 else "b", i, a, a + timedelta(seconds=rng.choice([0, 0.4, 1, 7, 300, 9000, 200000]))))
    points = [(rng.choice(["hot", "b"]), START + timedelta(seconds=rng.randrange(0, 30000), microseconds=rng.randrange(10 ** 6)))
              for _ in range(200)] + [(k, a) for k, _, a, _ in spans] + [(k, b) for k, _, _, b in spans]
    points = sorted(set(points))
    got = joins.covering_join(frame(spark, spans, "s string, id long, a timestamp_ntz, b timestamp_ntz"),
                              frame(spark, points, "s string, at timestamp_ntz"), "a", "b", "at", ["s"])
    want = [(i, t) for k, i, a, b in spans for key, t in points if key == k and a <= t <= b]
    assert rows(got, "id", "at") == sorted(want, key=repr)


def test_covering_join_with_lengths_far_apart(spark):
    spans = [("s", i, START + timedelta(seconds=40 * i), START + timedelta(seconds=40 * i + 1)) for i in range(300)]
    spans += [("s", 900, START - timedelta(days=20000), START + timedelta(seconds=5000)), ("s", 901, START, START - timedelta(seconds=1)),
              ("s", 902, None, START), ("t", 903, START, START), (None, 904, START, START)]
    points = [("s", START + timedelta(seconds=s)) for s in range(0, 12000, 7)] + [("s", START - timedelta(days=19999)), ("s", None), ("t", START), (None, START)]
    got = joins.covering_join(frame(spark, spans, "s string, id long, a timestamp_ntz, b timestamp_ntz"),
                              frame(spark, points, "s string, at timestamp_ntz"), "a", "b", "at", ["s"])
    want = [(i, t) for k, i, a, b in spans for key, t in points if k and t and a and key == k and a <= t <= b]
    assert rows(got, "id", "at") == sorted(want, key=repr)
    wrong = frame(spark, [("s", -5), ("t", None)], "s string, seconds long")  # lengths decide on the work only
    got = joins.covering_join(frame(spark, spans[:300], "s string, id long, a timestamp_ntz, b timestamp_ntz"),
                              frame(spark, points, "s string, at timestamp_ntz"), "a", "b", "at", ["s"], wrong)
    assert rows(got, "id", "at") == sorted((w for w in want if w[0] < 900), key=repr)


def test_include_exclude(spark):
    df = frame(spark, [("a",), ("b",), ("c",)], "n string")
    assert rows(joins.include_exclude(df, "n", ["a", "b"], ["b"])) == [("a",)]
    assert rows(joins.include_exclude(df, "n", [], ["b"])) == [("a",), ("c",)]


def test_property_bag_is_undone_by_rows(spark):
    wide = frame(spark, [(1, "x", "y"), (2, None, "z")], "id long, p string, q string")
    bag = pivots.to_property_rows(wide, ["id"], ["p", "q"])
    assert bag.count() == 3
    assert rows(pivots.property_bag(bag, ["id"], "name", "value", {"p": "p", "q": "q"})) == rows(wide)


def test_ordered_text_skips_nulls(spark):
    df = frame(spark, [(1, 3, "c"), (1, 1, "a"), (1, 2, None)], "g long, o long, v string")
    assert rows(df.groupBy("g").agg(textagg.ordered_text(F.col("v"), F.col("o"), "-"))) == [(1, "a-c")]


def test_changes(spark):
    df = frame(spark, [(1, "a", 5), (2, "b", None), (3, None, 7)], "id long, n string, v long")
    source = frame(spark, [(1, None), (9, 4)], "id long, v long")
    assert rows(changes.update_from(df, source, ["id"], ["v"])) == [(1, "a", None), (2, "b", None), (3, None, 7)]
    assert rows(changes.delete_where(df, F.col("v") > 5), "id") == [(1,), (2,)]
    assert rows(changes.delete_matching(df, source, ["id"]), "id") == [(2,), (3,)]
    kept, moved = changes.archive_split(df, F.col("v") > 5)
    assert rows(kept.unionByName(moved)) == rows(df)
    assert rows(changes.union_present({"x": df, "y": None})) == rows(df)


def test_archive_twice_is_archive_once(spark, tmp_path):
    df = frame(spark, [(1, 2016), (2, 2017), (3, None)], "id long, y long")
    for _ in range(2):
        changes.archive(df, F.col("y") == 2016, f"{tmp_path}/archive", f"{tmp_path}/kept", "b1")
    assert rows(spark.read.parquet(f"{tmp_path}/archive"), "id") == [(1,)]
    assert rows(spark.read.parquet(f"{tmp_path}/kept"), "id") == [(2,), (3,)]


def most_in_one_task(spark, df):
    """Largest share of the result one task holds, without merging of small partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return max(counts) / sum(counts)


def test_one_hot_key_is_spread_over_tasks(spark):
    """Nearly all rows share one key; no task may get most of them."""
    rows_ = spark.range(40000).select(
        F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("k"),
        F.timestamp_add("SECOND", F.col("id") * 9, F.lit("2024-01-01").cast("timestamp_ntz")).alias("t"), "id",
        F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    bucket = adjacent.time_bucket("t")
    spread = [
        adjacent.with_previous(rows_, ["k"], ["t", "id"], ["id"], bucket),
        adjacent.with_next(rows_, ["k"], ["t", "id"], ["id"], bucket),
        adjacent.with_earlier_time(rows_, ["k"], "t", bucket),
        adjacent.carry_forward(rows_, ["k"], "id", F.col("v"), adjacent.line_bucket("id", 500), "c"),
        adjacent.as_of_previous(rows_, rows_, ["k"], "t", bucket),
    ]
    for df in spread:
        assert most_in_one_task(spark, df) < 0.35


def test_greatest_per_key_is_limited_before_the_shuffle(spark):
    from helpers import plan_of
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    for ties in (False, True):
        plan = plan_of(ranking.top_per_group(df, ["k"], [F.desc("id")], 5, ties))
        assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_equal_rows_are_reduced_before_an_anti_join(spark):
    from helpers import plan_of
    left, right = spark.range(10).select("id"), spark.range(1000).select((F.col("id") % 2).alias("id"))
    plan = plan_of(changes.delete_matching(left, right, ["id"]))
    assert "HashAggregate" in plan


def test_newest_capture_of_each_server(spark):
    from opslens.operators import captures
    data = [(s, at(f"2024-01-{d:02d} 10:00:00"), n) for s, days in (("a", (1, 2, 3)), ("b", (1,))) for d in days for n in range(2)]
    df = frame(spark, data, "server_name string, captured_at timestamp_ntz, n int")
    got = captures.as_of_capture(df, "2024-01-02 12:00:00")
    assert rows(got.selectExpr("server_name", "day(captured_at)", "n")) == [("a", 2, 0), ("a", 2, 1), ("b", 1, 0), ("b", 1, 1)]
    assert rows(captures.as_of_capture(df, "2024-01-02 12:00:00", within_days=1).select("server_name").distinct()) == [("a",)]
