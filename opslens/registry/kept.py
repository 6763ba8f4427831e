"""What is kept beside the reports: archives, sketches of days, and reports as SQL functions."""

from pyspark.sql import DataFrame, functions as F

from opslens.operators import sketches
from opslens.plans import security, table_functions, workload
from opslens.registry import security as security_registry, workload as workload_registry
from opslens.registry.common import AS_OF, Query
from opslens.session import new_folder
from opslens.sources import archive


def archive_move(t) -> DataFrame:
    """Orders moved to an archive in two batches, the second of which died half way and was run again."""
    path, old = new_folder(t.spark, "orders"), new_folder(t.spark, "orders-archive")
    until = lambda year: F.year("o_orderdate") <= year
    archive.create(t.orders, path)
    archive.move(t.spark, path, old, until(1994), "to 1994")
    archive.write_moved(archive.current(t.spark, path).filter(F.year("o_orderdate") == 1995), old, "to 1996")  # and died here
    for _ in range(2):
        archive.move(t.spark, path, old, until(1996), "to 1996")
    kept = archive.current(t.spark, path).withColumn("placed", F.lit("kept"))
    return kept.unionByName(archive.archived(t.spark, path, old).drop("batch").withColumn("placed", F.lit("archived")))


def distinct_users(t) -> DataFrame:
    """Users per event type and week: the exact number, and whether merged sketches of the days come near it."""
    week = lambda c: F.date_trunc("week", c).cast("timestamp_ntz")
    days = sketches.daily(t.events, ["event_type"], F.col("ts").cast("date"), ["user_id"])
    near = sketches.distinct_over(days, ["event_type"], ["user_id"], week("day")).withColumnRenamed("span", "week_start")
    exact = t.events.groupBy("event_type", week("ts").alias("week_start")).agg(F.countDistinct("user_id").alias("users"))
    within = F.abs(F.col("distinct_user_id") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * sketches.error())
    return exact.join(near, ["event_type", "week_start"]).select("event_type", "week_start", "users", within.alias("within_error"))


def called(name: str, report, call: str):
    def run(t) -> DataFrame:
        table_functions.create(t.spark, name, report(t))
        return t.spark.sql(f"SELECT * FROM {call}")
    return run


LONG = called("long_transactions", lambda t: workload.long_transactions(t.sessions, t.session_transactions, t.database_transactions, t.active_requests,
                                                                        t.query_texts, t.jobs, AS_OF), "long_transactions(least_minutes => 20000)")
SCRIPT = called("permission_script", lambda t: security.permission_script(t.databases, t.database_principals, t.server_principals, t.role_members, t.database_permissions,
                                                                          t.objects, t.schemas), "permission_script()")
LOGIN = called("login_script", lambda t: security.login_script(t.server_principals, t.logins, t.sql_logins), "login_script('login_5')")

QUERIES = {
    "archive_move": Query(
        archive_move,
        """SELECT *, 'archived' AS placed FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'
        UNION ALL SELECT *, 'kept' FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"""),
    "distinct_users_over_days": Query(
        distinct_users,
        "SELECT event_type, date_trunc('week', ts) AS week_start, count(DISTINCT user_id) AS users, true AS within_error FROM events GROUP BY 1, 2"),
    "long_transactions_function": Query(LONG, f"SELECT * FROM ({workload_registry.LONG}) WHERE transaction_minutes >= 20000"),
    "permission_script_function": Query(SCRIPT, security_registry.QUERIES["permission_script"].sql),
    "login_script_function": Query(LOGIN, f"SELECT * FROM ({security_registry.QUERIES['login_script'].sql}) WHERE login_name = 'login_5'"),
}
