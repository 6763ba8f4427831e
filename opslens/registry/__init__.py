"""All registered queries by name."""

from __future__ import annotations

import importlib

from opslens.registry.common import Query

FAMILIES = ["backup", "jobs", "storage", "workload", "logs", "availability", "inventory", "security", "streams", "captured", "kept"]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        queries = importlib.import_module(f"opslens.registry.{family}").QUERIES
        repeated = found.keys() & queries.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        found.update(queries)
    return found
