"""Archives, sketches and SQL functions."""

import pytest
from pyspark.sql import functions as F

from helpers import frame, plan_of, rows
from opslens.operators import sketches
from opslens.plans import table_functions
from opslens.sources import archive, sinks


def test_a_move_loses_and_doubles_nothing_wherever_it_dies(spark, tmp_path):
    data = frame(spark, [(i, i % 10) for i in range(100)], "id long, age long")
    path, old = f"{tmp_path}/table", f"{tmp_path}/archive"
    whole = list(range(100))

    def ids():
        kept, gone = archive.current(spark, path), archive.archived(spark, path, old)
        return sorted(r["id"] for r in kept.collect()) + sorted(r["id"] for r in gone.collect())

    assert archive.create(data, path) and not archive.create(data, path)
    assert ids() == whole and archive.archived(spark, path, old).count() == 0
    archive.write_moved(data.filter("age = 9").limit(3), old, "one")  # died in the first phase
    assert ids() == whole
    data.filter("age < 8").write.parquet(f"{path}/rows/batch=one")    # died in the second, before it published
    assert ids() == whole
    assert archive.move(spark, path, old, F.col("age") >= 8, "one")
    assert archive.archived(spark, path, old).count() == 20 and sorted(ids()) == whole
    assert not archive.move(spark, path, old, F.col("age") >= 5, "one")  # that batch is done
    assert archive.move(spark, path, old, F.col("age") >= 5, "two") and archive.move(spark, path, old, F.lit(False), "none")
    assert archive.move(spark, path, old, F.lit(True), "rest") and archive.current(spark, path).count() == 0
    assert archive.move(spark, path, old, F.lit(True), "again") and sorted(ids()) == whole
    counts = {r["batch"]: r["moved"] for r in sinks.read_ledger(spark, path).collect()}
    assert counts == {"start": 0, "one": 20, "two": 30, "none": 0, "rest": 50, "again": 0}


def test_sketches_of_days_merge(spark):
    data = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).cast("int").alias("d"), (F.col("id") % 4001).alias("v"))
    days = sketches.daily(data, ["k"], F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")), ["v"])
    assert days.count() == 21
    exact = {r["k"]: r["n"] for r in data.groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
    for r in sketches.distinct_over(days, ["k"], ["v"]).collect():
        assert abs(r["distinct_v"] - exact[r["k"]]) <= sketches.error() * exact[r["k"]]
    assert "hll_union_agg" in plan_of(sketches.distinct_over(days, ["k"], ["v"]))


def test_table_functions_have_defaults_and_filter_below(spark):
    report = frame(spark, [("s", f"login_{i}", "x") for i in range(5)], "server_name string, login_name string, script string")
    table_functions.create(spark, "login_script", report)
    assert spark.sql("SELECT * FROM login_script()").count() == 5
    assert rows(spark.sql("SELECT login_name FROM login_script(of_login => 'login_3') l")) == [("login_3",)]
    table_functions.create(spark, "logins_from", report, "lowest STRING DEFAULT 'login_1'", "login_name >= lowest")
    assert spark.sql("SELECT * FROM logins_from()").count() == 4 and spark.sql("SELECT * FROM logins_from('login_4')").count() == 1
    with pytest.raises(KeyError):
        table_functions.create(spark, "unknown", report)
