"""Chat formatting: logged snapshots collapse into the longest conversation, which is then rendered.

A log often holds a conversation several times, cut after each turn. Each turn gets a
hash of its place and content; running sums of these hashes along a conversation are
the prefix hashes. A conversation whose whole hash is a proper prefix of another one
goes (an anti join on hash and length), and so do copies, of which the smallest id
stays. Only hashes take part in that; texts are read again for what remains.

Defined cases: turns are ordered by turn number (null first), then by content hash; an
exactly repeated row is one turn; a null conv_id is one conversation of its own; a null
role reads ``unknown`` and a null text is empty; a text cannot open or close a turn,
since ``<|`` in it becomes ``< |``. Columns beside the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TURN = ["conv_id", "turn", "role", "text"]
PREFIX = ["s1", "s2", "s3", "s4"]


def _hashed(conversations: DataFrame) -> DataFrame:
    """The four columns and two 64-bit hashes of a turn's content."""
    content = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return conversations.select(
        *TURN, F.xxhash64(F.lit(1), *content).alias("a"), F.xxhash64(F.lit(2), *content).alias("b"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, n_turns, s1..s4): the rolling hash of the first n turns of each conversation.

    The sums add 32-bit halves in longs, so they stay exact for 2^31 turns.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    turns = _hashed(conversations).select("conv_id", "turn", "a", "b")
    same = (F.lag("a").over(order).eqNullSafe(F.col("a")) & F.lag("b").over(order).eqNullSafe(F.col("b"))
            & F.lag("turn").over(order).eqNullSafe(F.col("turn")))
    first = turns.withColumn("own", F.when(same, 0).otherwise(1))
    placed = first.withColumn("n", F.sum("own").over(so_far)).filter("own = 1")
    for name, seed in (("x", 3), ("y", 4)):
        placed = placed.withColumn(name, F.xxhash64(F.lit(seed), F.col("n"), F.col("a"), F.col("b")))
    low = F.lit(0xFFFFFFFF)
    halves = {"s1": F.col("x").bitwiseAND(low), "s2": F.shiftrightunsigned("x", 32),
              "s3": F.col("y").bitwiseAND(low), "s4": F.shiftrightunsigned("y", 32)}
    return placed.select(
        "conv_id", "n", F.max("n").over(Window.partitionBy("conv_id")).alias("n_turns"),
        *[F.sum(half).over(so_far).alias(name) for name, half in halves.items()])


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other one continues."""
    rolling = prefixes(conversations)
    whole = (rolling.filter("n = n_turns").groupBy("n", *PREFIX)
             .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    inner = rolling.filter("n < n_turns").select("n", *PREFIX).distinct()
    return whole.join(inner, ["n", *PREFIX], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered): one row per maximal conversation."""
    kept = maximal(conversations).withColumnRenamed("conv_id", "kept_id")
    turns = _hashed(conversations)
    turns = turns.join(kept, turns["conv_id"].eqNullSafe(kept["kept_id"]))
    turn = F.struct("turn", "a", "b", "role", "text")
    grouped = (turns.groupBy("conv_id", "n_turns", "n_copies")
               .agg(F.sort_array(F.collect_set(turn)).alias("turns")))
    shown = F.transform("turns", lambda t: F.concat(
        F.lit("<|im_start|>"), F.replace(F.coalesce(t["role"], F.lit("unknown")), F.lit("<|"), F.lit("< |")), F.lit("\n"),
        F.replace(F.coalesce(t["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n")))
    return grouped.select("conv_id", F.col("n_turns").cast("long"), F.col("n_copies").cast("long"),
                          F.array_join(shown, "").alias("rendered"))


#: The same question with whole lists of turns instead of hashes; a turn number counts once per conversation here.
SQL = """
WITH convs AS (
  SELECT conv_id, list((role, text) ORDER BY turn) AS turns,
         string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10)
                    || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
  FROM conversations GROUP BY conv_id),
copies AS (
  SELECT turns, any_value(rendered) AS rendered, min(conv_id) AS conv_id, count(*) AS n_copies
  FROM convs GROUP BY turns)
SELECT conv_id, len(turns)::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, rendered
FROM copies c
WHERE NOT EXISTS (
  SELECT 1 FROM copies d
  WHERE d.turns[1] = c.turns[1] AND len(d.turns) > len(c.turns) AND d.turns[1:len(c.turns)] = c.turns)
"""
