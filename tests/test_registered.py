"""Every registered query against DuckDB on the smallest data, and its plan."""

import re

import pytest

import __spark_entry__ as contract
import oracle
from helpers import plan_of
from opslens.registry import all_queries

FOLDER = "/root/testdata/sf0.001"
OWN = all_queries()  # the corpus queries have tests of their own
RUNS = {name: run for name, run in contract.queries().items() if name in OWN}
SQLS = contract.oracle_sql()
# Reports that run jobs while they are built: their plan is that of the last step.
EAGER = {"blocking_tree", "block_leaders", "stream_event_counts", "stream_outages", "stream_dedup", "stream_late_counts", "stream_counter_rates",
         "stream_alert_responses", "stream_milestones", "archive_move", *(name for name in OWN if name.endswith("_as_of"))}
# At this size no row of the data qualifies.
MAY_BE_EMPTY = {"bad_login_jobs", "jobs_running_at", "last_service_start"}


@pytest.fixture(scope="module")
def con():
    return oracle.duck_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_same_as_duckdb(spark, con, name):
    assert name in SQLS
    problems = oracle.compare(spark, con, FOLDER, name, RUNS[name], SQLS[name])
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert problems == []


@pytest.mark.parametrize("name", sorted(set(RUNS) - EAGER))
def test_plan_spreads_work(spark, name):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")  # as with large tables: at this size everything would be broadcast
    try:
        plan = plan_of(RUNS[name](spark, FOLDER))
    finally:
        spark.conf.unset(key)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if re.search(r"[-:] *Window \[", line):
            assert not re.search(r"windowspecdefinition\([^,]*(ASC|DESC)", line), f"window over everything: {line[:200]}"


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["server_name", "database_name", "type", "avg_hours"]
    assert df.count() > 0


def test_every_captured_table_has_a_schema(spark):
    from opslens.bindings import Ops
    from opslens.bindings.tables import TABLES
    from opslens.sources.schemas import SCHEMAS
    derived = {"ring_buffer_values", "xe_values", "alert_events", "ini_lines"}
    tables = Ops(spark, FOLDER)
    for name in set(TABLES) - derived:
        declared = dict(spark.createDataFrame([], SCHEMAS[name]).dtypes)
        bound = {c: kind for c, kind in getattr(tables, name).dtypes if c != "server_name"}
        assert bound.items() <= declared.items(), (name, bound.items() - declared.items())


def test_a_report_starts_from_captured_tables(spark, tmp_path):
    from opslens.bindings import Ops
    from opslens.plans import workload
    from opslens.sources import readers
    tables = Ops(spark, FOLDER)
    names = ["sessions", "session_transactions", "database_transactions", "active_requests", "query_texts", "jobs"]
    from pyspark.sql import functions as F
    for name in names:
        for hour, rows in ((1, getattr(tables, name).limit(3)), (2, getattr(tables, name)), (5, getattr(tables, name).limit(2))):
            at = F.expr(f"TIMESTAMP_NTZ'2024-01-30 0{hour}:00:00'")
            rows.withColumn("captured_at", at).withColumn("captured_date", at.cast("date")).write.mode("append").partitionBy("captured_date").parquet(f"{tmp_path}/{name}")
    read = [readers.read_state(spark, str(tmp_path), name, "2024-01-30 04:00:00", within_days=1) for name in names]
    got = workload.long_transactions(*read, "2024-01-31 00:00:00")
    want = workload.long_transactions(*[getattr(tables, name) for name in names], "2024-01-31 00:00:00")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0
