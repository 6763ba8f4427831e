"""Ordered text over the rows of a key.

For keys with a bounded number of rows only (columns of an index, samples of a
ring buffer): the text is one value, so it lives in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ordered_text(value: Column, order: Column, separator: str) -> Column:
    """Aggregate: non-null values joined in ``order``."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: p["v"]), separator)
