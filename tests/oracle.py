"""Runs registered queries in Spark and DuckDB and compares names, types and rows.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KINDS = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
WHOLE = {"BIGINT", "INTEGER", "HUGEINT", "SMALLINT", "TINYINT"}


def session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("opslens-tests")
             .config("spark.sql.shuffle.partitions", str(cores))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return v


def compare(spark: SparkSession, con, folder: str, name: str, run, sql: str) -> list[str]:
    """Differences between the two engines, as lines; empty when they agree."""
    df = run(spark, folder)
    result = con.execute(sql)
    duck_columns = {d[0]: str(d[1]) for d in result.description}
    order = sorted(df.columns)
    problems = []
    if order != sorted(duck_columns):
        return [f"columns {order} against {sorted(duck_columns)}"]
    for field in df.schema.fields:
        kind, other = field.dataType.simpleString(), duck_columns[field.name]
        if kind == "bigint":
            ok = other in WHOLE
        else:
            ok = other.startswith(KINDS.get(kind, "?"))
        if not ok:
            problems.append(f"type of {field.name}: {kind} against {other}")
    at = [df.columns.index(c) for c in order]
    spark_rows = Counter(tuple(_plain(r[i]) for i in at) for r in df.collect())
    names = list(duck_columns)
    at = [names.index(c) for c in order]
    duck_rows = Counter(tuple(_plain(r[i]) for i in at) for r in result.fetchall())
    if spark_rows != duck_rows:
        extra, missing = spark_rows - duck_rows, duck_rows - spark_rows
        problems.append(f"{sum(spark_rows.values())} rows against {sum(duck_rows.values())}; "
                        f"{sum(extra.values())} only in Spark, {sum(missing.values())} only in DuckDB")
        for label, rows in (("S", extra), ("D", missing)):
            for row in sorted(rows, key=repr)[:2]:
                problems.append(f"  {label} {dict(zip(order, row))}")
    if not problems and not spark_rows:
        problems.append("no rows")
    return problems


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as contract
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = session(), duck_connection(folder)
    runs, sqls = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in args.names or runs:
        begin = time.time()
        try:
            if name in sqls:
                problems = compare(spark, con, folder, name, runs[name], sqls[name])
            else:
                problems = [] if runs[name](spark, folder).count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(problems)
        print(f"{'DIFF' if problems else 'ok  '} {name} {time.time() - begin:.1f}s"
              + ("" if name in sqls else " (rows only)"), *problems, sep="\n" if problems else "", flush=True)
    print(f"{bad} with problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
