"""Walk of a parent-pointer forest from its roots, by pointer doubling.

Each round every unfinished node jumps to its ancestor's ancestor, so a tree of
depth d takes about log2(d) joins instead of d. A round that finishes no node
proves the rest hangs on a cycle or a missing parent and is never reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslens.session import cut_lineage


def walk(nodes: DataFrame, keys: list[str], node: str, parent: str, pad: int = 10) -> DataFrame:
    """Adds ``root``, ``depth`` and ``path`` to the nodes reached from a root.

    A node whose ``parent`` is null is a root. ``path`` joins the padded node
    numbers from the root down, so it sorts a tree in depth-first order.
    """
    own = F.lpad(F.col(node).cast("string"), pad, "0")
    start = nodes.select(
        *keys, node, F.col(parent).alias("_up"), own.alias("path"), F.lit(0).alias("depth"),
        F.when(F.col(parent).isNull(), F.col(node)).alias("root"),
    )
    state = cut_lineage(start)
    reached, waiting = _tally(state)
    while waiting:
        above = state.select(
            *keys, F.col(node).alias("_up"), F.col("_up").alias("_next"),
            F.col("path").alias("_path"), F.col("depth").alias("_depth"),
            F.col("root").alias("_root"))
        moved = (
            state.filter("root is null").join(above, [*keys, "_up"])
            .select(*keys, node, F.col("_next").alias("_up"),
                    F.concat("_path", "path").alias("path"),
                    (F.col("depth") + F.col("_depth") + 1).alias("depth"),
                    F.col("_root").alias("root"))
        )
        state = cut_lineage(state.filter("root is not null").unionByName(moved))
        before = reached
        reached, waiting = _tally(state)
        if reached == before:
            break
    return state.filter("root is not null").drop("_up")


def _tally(state: DataFrame) -> tuple[int, int]:
    row = state.agg(F.count("root"), F.count(F.when(F.col("root").isNull(), 1))).first()
    return row[0], row[1]
