"""Reports as SQL table functions with parameters and defaults.

A report over its tables becomes a view, and a SQL function selects from it; Spark puts the
function's body in place of the call, so its parameters are filters on the report's plan
and reach the scans where columns allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Parameters and condition of each function over the view of its report.
FUNCTIONS = {
    "long_transactions": ("least_minutes BIGINT DEFAULT 1, in_database STRING DEFAULT NULL",
                          "transaction_minutes >= least_minutes AND (in_database IS NULL OR database_name = in_database)"),
    "permission_script": ("in_database STRING DEFAULT NULL", "in_database IS NULL OR database_name = in_database"),
    "login_script": ("of_login STRING DEFAULT NULL", "of_login IS NULL OR login_name = of_login"),
}


def create(spark: SparkSession, name: str, report: DataFrame, parameters: str | None = None, condition: str | None = None) -> None:
    """A temporary table function ``name`` over a report, for ``SELECT * FROM name(...)``.

    Without parameters of their own, the reports of ``FUNCTIONS`` get those listed there.
    """
    if parameters is None:
        parameters, condition = FUNCTIONS[name]
    view = f"{name}_rows"
    report.createOrReplaceTempView(view)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in report.schema.fields)
    shown = ", ".join(f"`{f.name}`" for f in report.schema.fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN SELECT {shown} FROM {view} WHERE {condition}")
