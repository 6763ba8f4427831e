"""Embedding near-duplicates by NN-descent.

Only vectors with equal labels are compared. Every vector starts with neighbours from
random hyperplane leaves; the more hyperplanes a label needs, the more sets of them, so
that a pair at the threshold shares a leaf as often. Then, round after round, each vector proposes its
neighbours (in both directions) to one another, a join on the vector they share: what is
near a neighbour tends to be near itself. Lists hold the ``k`` nearest; a list in which
all are above the threshold is saturated, and it may hold twice as many from the next
round on. Every pair found at or above the threshold is an edge. Rounds go on until no
list changes; only vectors with a new neighbour, or with one whose list has grown, propose.

A crowd of near copies would need lists as long as the crowd. So when the rounds end,
saturated lists are enlarged to what they stand for: inside a component of edges that
holds a saturated list all members are compared, in blocks of bounded size, so that
counts of links are whole there.

The recall is measured before links are given out: of each label, every 50th id (by hash
about ``asked`` of these where there are more) is compared with the whole label. A label
short of ``recall`` gets further tables, twice as many each time, and rounds of its own;
one that is short after ``passes`` of these is compared whole, block by block. The links
the measurement meets are not added, so that it says something about all the others.

Hubs are split: the lists that meet at a vector are dealt into blocks of at most
``block`` members; every vector with its own nearest is in all of them. Equal vectors
are one point with a multiplicity.

Defined cases: a null label, a null, empty or zero vector, and one with null or
non-finite components links with nothing; vectors of different lengths do not link;
repeated ids are points of their own that share an id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from opslens.llm.common import written
from opslens.llm.components import components

THRESHOLD = 0.93
RECALL = 0.99
#: How often a pair at the threshold shares a first leaf; a label of 2,000 needs 6 tables for that.
MEET = 0.977
MOST_BITS = 40
PASS = 1 << 20  # seeds between two passes


def points(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, node, unit): usable vectors of length one in doubles; node is a hash of label and vector."""
    embedding = F.col("embedding").cast("array<double>")
    usable = (F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x * x))
    own = vectors.filter(usable).withColumn("norm", norm).filter("norm > 0")
    unit = F.transform(embedding, lambda x: x / F.col("norm"))
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.xxhash64("label", "embedding").alias("node"), unit.alias("unit"))


def _matrix(column) -> np.ndarray:
    """Vectors of one length, from their bytes."""
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, arrays of doubles, as bytes."""
    for batch in batches:
        units = batch.column(batch.num_columns - 1)
        packed = [np.asarray(u.values, dtype="<f8").tobytes() for u in units]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=batch.schema.names)


PAIR = "a long, b long, similarity double"
MEMBER = ["first_key", "second_key", "node", "k", "worst", "unit"]


def _near(node: np.ndarray, k: np.ndarray, worst: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each member of a block the others that would enter its list: at most as many as that holds."""
    similar = x @ x.T
    np.fill_diagonal(similar, -2.0)
    take = min(len(node) - 1, int(k.max()))
    if take < 1:
        return node[:0], node[:0], similar[0, :0]
    best = np.argpartition(-similar, take - 1, axis=1)[:, :take]
    rows = np.repeat(np.arange(len(node)), take)
    columns = best.ravel()
    found = similar[rows, columns]
    better = found > worst[rows]
    return node[rows[better]], node[columns[better]], found[better]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``MEMBER`` sorted by the two keys: what the members of each block propose to one another."""
    def proposed(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, k, worst = (block[c].to_numpy() for c in ("node", "k", "worst"))
        return _near(node, k, worst, _matrix(block["unit"].to_pylist()))

    def batch_of(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                               names=["a", "b", "similarity"])

    open_, key, found, size = [], None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1, [len(one)]))
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if open_ and (one[start], two[start]) != key:
                found.append(proposed(pa.Table.from_batches(open_)))
                size += len(found[-1][0])
                open_ = []
                if size > 100_000:
                    yield batch_of(found)
                    found, size = [], 0
            key = (one[start], two[start])
            open_.append(batch.slice(start, stop - start))
    if open_:
        found.append(proposed(pa.Table.from_batches(open_)))
    if found:
        yield batch_of(found)


def _proposals(members: DataFrame) -> DataFrame:
    keys = MEMBER[:2]
    return members.select(*MEMBER).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_met, PAIR)


def _bits(dimensions: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).normal(size=(bits, dimensions))


def _tables(threshold: float, least: int) -> list[int]:
    """For each number of hyperplanes how many sets of them let a pair at the threshold meet with odds ``MEET``."""
    same_side = 1 - acos(min(1.0, max(-1.0, threshold))) / pi
    together = [same_side ** bits for bits in range(MOST_BITS + 1)]
    return [max(least, ceil(log(1 - MEET) / log(1 - p)) if 0 < p < 1 else 1) for p in together]


def _started(table: DataFrame, k: int, threshold: float, tables: int, leaf: int, seed: int, times: int = 1) -> DataFrame:
    """First neighbours: members of the same hyperplane leaf, for several sets of hyperplanes.

    The number of hyperplanes follows from the size of the label, and the number of sets,
    ``tables`` or more, from that of hyperplanes; a leaf that is still larger than the bound is dealt into blocks by hash. A label is told by a hash of it
    and of the vectors' length.
    """
    sizes = table.groupBy("kind").agg(F.count(F.lit(1)).alias("members"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("members") / leaf)), F.lit(0)), F.lit(MOST_BITS)).cast("int")
    wanted = F.element_at(F.array(*[F.lit(times * t) for t in _tables(threshold, tables)]), F.col("bits") + 1)
    sized = table.join(sizes.select("kind", bits.alias("bits")).withColumn("tables", wanted), "kind")

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, same in frame.groupby("dimensions"):
                x, b, wanted = _matrix(list(same["unit"])), same["bits"].to_numpy(), same["tables"].to_numpy()
                for t in range(int(wanted.max())):
                    own = wanted > t
                    on = x[own] @ _bits(int(length), MOST_BITS, seed + t).T > 0
                    code = (on & (np.arange(MOST_BITS)[None, :] < b[own, None])) @ (1 << np.arange(MOST_BITS, dtype=np.int64))
                    yield pd.DataFrame({"node": same["node"][own], "kind": same["kind"][own], "side": t, "cell": code})

    celled = sized.select("node", "kind", "dimensions", "unit", "bits", "tables").mapInPandas(cells, "node long, kind long, side int, cell long")
    celled = written(celled, "nn-cells")
    crowd = celled.groupBy("kind", "side", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf)).alias("deals"))
    deal = F.pmod(F.xxhash64(F.lit(seed), "side", "node"), F.col("deals"))
    dealt = celled.join(crowd, ["kind", "side", "cell"]).select(
        "node", F.xxhash64("kind", "side").alias("first_key"), (F.col("cell") * (1 << 23) + deal).alias("second_key"))
    return _proposals(dealt.join(table.select("node", "unit"), "node").withColumn("k", F.lit(k)).withColumn("worst", F.lit(-2.0)))


def _best(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The nearest of each point, as many as its list holds."""
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    both = pairs.join(lists.select("node", "k"), F.col("a") == F.col("node")).drop("node")
    return both.withColumn("place", F.row_number().over(order)).filter("place <= k").drop("place", "k")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _classes(table: DataFrame) -> DataFrame:
    """(node, kind, dimensions, copies, unit): equal vectors of a label as one, the vector as bytes."""
    kind = F.xxhash64("p.label", F.size("p.unit"))
    classes = table.groupBy("node").agg(F.min(F.struct("label", "unit")).alias("p"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select("node", kind.alias("kind"), F.size("p.unit").alias("dimensions"), "copies", "p.unit")
    return written(classes.mapInArrow(_packed, "node long, kind long, dimensions int, copies long, unit binary"), "nn-classes")


def _refined(unit: DataFrame, graph: DataFrame, links: DataFrame, lists: DataFrame, found: DataFrame, threshold: float, block: int,
             longest: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph, links, lists) after rounds that begin with the pairs found and end when no list changes."""
    while True:
        links = written(links.unionByName(_links(found, threshold)).distinct(), "nn-links")
        before, graph = graph, written(_best(_nearest(graph.unionByName(found)), lists), "nn-graph")
        full = graph.groupBy("a").agg(F.count(F.lit(1)).alias("held"), F.min("similarity").alias("least"))
        grown = lists.select("node", "k").join(full, F.col("node") == F.col("a"), "left")
        is_full = F.coalesce(F.col("held") >= F.col("k"), F.lit(False))
        saturated = is_full & (F.col("least") >= threshold)
        lists = written(grown.select("node", F.when(saturated, F.greatest("k", F.least(F.col("k") * 2, F.lit(longest)))).otherwise(F.col("k")).alias("k"),
                                     F.when(is_full & ~saturated, F.col("least")).otherwise(-2.0).alias("worst"),
                                     (saturated & (F.col("k") < longest)).alias("grew")), "nn-lists")
        around = graph.select(F.col("a").alias("at"), F.col("b").alias("node")).unionByName(graph.select(F.col("b").alias("at"), F.col("a").alias("node")))
        around = around.unionByName(unit.select(F.col("node").alias("at"), "node")).distinct()
        new = graph.join(before, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("at"))
        longer = around.join(lists.filter("grew").select("node"), "node", "left_semi").select("at")
        active = written(new.unionByName(longer).distinct(), "nn-active")
        if not active.count():
            return graph, links, lists
        around = written(around.join(active, "at", "left_semi"), "nn-around")
        crowd = around.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / block).alias("deals"))
        seed += 1
        deal = F.pmod(F.xxhash64(F.lit(seed), "at", "node"), F.col("deals"))
        dealt = around.join(crowd, "at").select("node", F.col("at").alias("first_key"), deal.alias("second_key"))
        proposed = _proposals(dealt.join(unit, "node").join(lists.select("node", "k", "worst"), "node"))
        found = written(_nearest(_both_ways(written(_nearest(proposed), "nn-proposed"))), "nn-found")


def edges(vectors: DataFrame, threshold: float = THRESHOLD, k: int = 10, tables: int = 6, leaf: int = 48, block: int = 256,
          longest: int = 160, seed: int = 1, recall: float = RECALL, passes: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, classes, links): links (a, b) between classes of equal vectors, a < b, all verified in doubles."""
    table = written(points(vectors), "nn-points")
    classes = _classes(table)
    unit = classes.select("node", "unit")
    truth = written(_truth(table, classes, threshold), "nn-truth")
    found = written(_nearest(_both_ways(_started(classes, k, threshold, tables, leaf, seed))), "nn-start")
    graph, links = found.filter(F.lit(False)), _links(found, threshold).filter(F.lit(False))
    lists = classes.select("node", F.lit(k).alias("k"))
    for i in range(passes + 1):
        graph, links, lists = _refined(unit, graph, links, lists, found, threshold, block, longest, seed + PASS * i)
        links = written(_completed(unit, graph, links, k, threshold, block), "nn-links")
        short = written(_short(truth, links, recall), "nn-short")
        if not short.count():
            break
        left = classes.join(short, "kind", "left_semi")
        if i == passes:
            inside = _compared(left.select("node", F.col("kind").alias("root")), unit, threshold, block)
            links = written(links.unionByName(inside).distinct(), "nn-links")
        else:
            further = _started(left, k, threshold, tables, leaf, seed + PASS * (i + 1), 2 ** (i + 1))
            found = written(_nearest(_both_ways(further)), "nn-start")
    return table, classes, links


def _links(pairs: DataFrame, threshold: float) -> DataFrame:
    near = pairs.filter(F.col("similarity") >= threshold)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _completed(unit: DataFrame, graph: DataFrame, links: DataFrame, k: int, threshold: float, block: int) -> DataFrame:
    """Adds all links inside components that hold a saturated list, one of ``k`` links or more."""
    roots = written(components(links), "nn-roots")
    saturated = graph.filter(F.col("similarity") >= threshold).groupBy("a").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= k)
    full = roots.join(saturated, F.col("node") == F.col("a"), "left_semi").select("root").distinct()
    return links.unionByName(_compared(roots.join(full, "root", "left_semi"), unit, threshold, block)).distinct()


def _compared(crowd: DataFrame, unit: DataFrame, threshold: float, block: int) -> DataFrame:
    """All links (a, b) between members (node, root) of one root, comparing them block by block."""
    sizes = crowd.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = crowd.join(sizes, "root").join(unit, "node")
    own = own.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets every block once: it is sent to the pairs (own, other) with own first or last
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("own", j).alias("first"), F.greatest("own", j).alias("last")))
    sent = own.withColumn("meets", F.explode(others)).select("root", "meets.*", "own", "node", "unit")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["own"] == frame["first"]], frame[frame["own"] == frame["last"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        i, j = np.nonzero(_matrix(list(left["unit"])) @ _matrix(list(right["unit"])).T >= threshold)
        a, b = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b].drop_duplicates()

    return sent.groupBy("root", "first", "last").applyInPandas(compare, "a long, b long")


def _truth(table: DataFrame, classes: DataFrame, threshold: float, every: int = 50, asked: int = 4096, block: int = 512, rows: int = 8192) -> DataFrame:
    """(kind, a, b): the links of every 50th id, found by comparing these queries with their whole label.

    Of a label with more than ``asked`` such vectors about so many are taken, by hash, so the work follows
    the rows. A pair closer to the threshold than doubles can tell is left out.
    """
    queries = classes.join(table.filter(F.col("vec_id") % every == 0).select("node").distinct(), "node", "left_semi")
    thin = queries.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / asked).alias("thin"))
    queries = queries.join(thin, "kind").filter(F.pmod(F.xxhash64(F.lit(every), "node"), F.col("thin")) == 0)
    queries = written(queries.select("kind", "node", "unit"), "nn-queries")
    parts = classes.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
    own = classes.join(parts, "kind").select("kind", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "unit")
    sent = queries.join(parts, "kind").select("kind", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "unit")

    def compare(asking: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(all_):
            return pd.DataFrame({"kind": [], "a": [], "b": []})
        x, node, out = _matrix(list(all_["unit"])), all_["node"].to_numpy(), []
        for start in range(0, len(asking), block):
            q = asking.iloc[start:start + block]
            i, j = np.nonzero(_matrix(list(q["unit"])) @ x.T >= threshold + 1e-9)
            a, b = q["node"].to_numpy()[i], node[j]
            out.append(pd.DataFrame({"kind": all_["kind"].iloc[0], "a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b])
        return pd.concat(out)

    both = sent.groupBy("kind", "part").cogroup(own.groupBy("kind", "part"))
    return both.applyInPandas(compare, "kind long, a long, b long").distinct()


def _short(truth: DataFrame, links: DataFrame, recall: float) -> DataFrame:
    """The kinds of which ``links`` holds a smaller share of the true links than ``recall``."""
    seen = truth.join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left").groupBy("kind").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("all"))
    return seen.filter(F.col("hits") < F.lit(recall) * F.col("all")).select("kind")


def grouped(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    table, classes, links = edges(vectors, **options)
    copies = classes.select("node", "copies")
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = ways.join(copies, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("copies").alias("others"))
    lows = table.groupBy("node").agg(F.min("vec_id").alias("low"))
    placed = lows.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = (placed.join(lowest, "root").join(copies, "node").join(counted, F.col("node") == F.col("a"), "left")
             .select(F.col("node").alias("of"), "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    own = table.select(F.col("vec_id").alias("v"), F.col("node").alias("of")).join(named, "of").drop("of")
    # rows of one id share the id; all its rows get its smallest component and the sum of its links
    own = own.groupBy("v").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    both = ids.join(own, F.col("vec_id") == F.col("v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return both.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       (F.col("vec_id") == component).alias("kept"))


def audit(vectors: DataFrame, links: DataFrame, threshold: float = THRESHOLD, every: int = 50, block: int = 512) -> tuple[int, int]:
    """(found, all): links of every 50th id, by comparing these queries with their whole label, against ``links`` between classes."""
    table = written(points(vectors), "nn-points")
    truth = _truth(table, _classes(table), threshold, every, block=block).select("a", "b")
    row = truth.join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return row[0], row[1]


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
                   WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, to_id) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.to_id),
c AS (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = c.vec_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id
"""
