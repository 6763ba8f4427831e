"""Binding of the reports to the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from opslens.bindings.dialect import DuckSpelling, SparkSpelling
from opslens.bindings.tables import DRIVER_TABLES, TABLES
from opslens.sources.schemas import DRIVER_SCHEMAS

_HOLE = re.compile(r"\{(\w+)\}")


class Ops:
    """Operations tables of one data folder as attributes, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in DRIVER_TABLES:
                reader = self.spark.read
                if name in DRIVER_SCHEMAS:  # declared, so no file is opened to plan a query
                    reader = reader.schema(DRIVER_SCHEMAS[name])
                frame = reader.parquet(f"{self.folder}/{name}.parquet")
            elif name in TABLES:
                sql = TABLES[name](SparkSpelling())
                frame = self.spark.sql(sql, **{t: getattr(self, t) for t in set(_HOLE.findall(sql))})
            else:
                raise AttributeError(name)
            self._frames[name] = frame
        return self._frames[name]


def duck(query: str) -> str:
    """DuckDB query whose ``{table}`` holes are bound tables, given as leading CTEs."""
    ctes: dict[str, str] = {}

    def need(text: str) -> None:
        for name in _HOLE.findall(text):
            if name in TABLES and name not in ctes:
                body = TABLES[name](DuckSpelling())
                need(body)
                ctes[name] = _HOLE.sub(r"\1", body)

    need(query)
    body = _HOLE.sub(r"\1", query).strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if not ctes:
        return body
    heads = ",\n".join(f"{n} AS ({t})" for n, t in ctes.items())
    if body.upper().startswith("WITH "):
        rest = re.sub(r"(?i)^WITH\s+(RECURSIVE\s+)?", "", body)
        return f"WITH {recursive}{heads},\n{rest}"
    return f"WITH {heads}\n{body}"
