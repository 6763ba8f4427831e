"""N-gram Jaccard join over count vectors.

Every document is a set of hashed five-word shingles. The shingles are hashed into
``GROUPS`` groups; a document's counts per group are a point, and the summed minima of
two points bound the overlap of the two sets from above. Points are indexed in R-trees:
a leaf holds points of like size and the largest count per coordinate, so a leaf whose
bound is too small is skipped whole. A set of up to ``EXACT`` shingles travels as 16 bits of
each, in no more bytes than counts; the counts follow from these, and a pair of two such
sets must have the overlap in these bits, too, so that crowds just below the limit do not
pair up. What survives is verified on the whole sets.

So that no tree holds the corpus, trees are built per *key*: a document belongs to the
trees of its ``KEYS`` smallest shingle hashes. Of the ``KEYS`` smallest of a linked
pair's union each is shared with probability 0.75 or more, so a pair meets in about 36
trees; that it meets in none has a probability below 1e-20. Sets of up to ``KEYS``
shingles are keyed whole and miss nothing at all. Trees with more than ``hot`` points
(common passages) are left out by documents with at most a quarter of their keys in such
trees: they still meet in a cold one (missed with probability below 1e-12).

Groups of copies do not pair up. Equal sets are one point. Each tree first offers its
middle point, the one nearest to the mean of its counts, to all others; only points that
this leaves in different components are then compared with each other.

Defined cases: a null or empty text has no shingles and links with nothing; fewer than
five words are one shingle; repeated rows are equal sets; a row without id takes no part
and has no component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from opslens.llm.common import bounded_batches, written
from opslens.llm.components import components
from opslens.llm.shingles import mixed, shingle_set

GROUPS = 256
FULL = (1 << 16) - 1  # a count that is stored as this may be any larger number
KEYS = 48
LEAF = 64
EXACT = GROUPS  # 16 bits of so many shingles take the bytes of a point
#: A pair is linked when SCALE * overlap >= SHARE * (size + size); for a similarity of 75 % that is 175 and 75.
SCALE, SHARE = 175, 75


def text_hash() -> Column:
    """Tells texts of one id apart; a null text is none of them."""
    return F.xxhash64(F.col("text").isNull(), "text").alias("text_hash")


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, node, check, keys, counts): size, a 128-bit hash of the set, its least hashes, its point.

    ``counts`` are the sorted low 16 bits of each shingle for sets of up to ``EXACT``, else the point itself.
    """
    bounded_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()),
                        ("keys", pa.list_(pa.int64())), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in range(5)]
            for text in batch.column(2).to_pylist():
                own = shingle_set(text)
                spread = mixed(own + np.uint64(0x9E3779B97F4A7C15))
                rows[0].append(len(own))
                rows[1].append(int(own.sum(dtype=np.uint64).astype(np.int64)))
                rows[2].append(int(spread.sum(dtype=np.uint64).astype(np.int64)))
                rows[3].append(own[:KEYS].astype(np.int64))
                if len(own) <= EXACT:
                    rows[4].append(np.sort((own & np.uint64(FULL)).astype("<u2")).tobytes())
                else:
                    counts = np.bincount((own % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
                    rows[4].append(np.minimum(counts, FULL).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(r, f.type) for r, f in zip(rows, list(schema)[2:], strict=True)]], schema=schema)

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(), "text")
    return narrow.mapInArrow(run, "doc_id long, text_hash long, n long, node long, check long, keys array<long>, counts binary")


def survivors(sizes: np.ndarray, component: np.ndarray, points: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of one tree in different components whose bound allows a link, as places in the arrays."""
    order = np.lexsort((component, sizes))
    sizes, component, points = sizes[order], component[order], points[order]
    m = len(sizes)
    first = np.arange(0, m, LEAF)
    top = np.maximum.reduceat(points, first, axis=0)
    least = sizes[first]
    found = []
    for leaf, start in enumerate(first):
        stop = min(start + LEAF, m)
        own, own_sizes = points[start:stop], sizes[start:stop]
        near = leaf + np.flatnonzero(SHARE * (least[leaf:] + own_sizes[0]) <= SCALE * own_sizes[-1])  # no overlap exceeds the smaller size
        if not len(near):
            continue
        bound = np.concatenate([np.minimum(own[:, None, :], top[None, near[i:i + LEAF], :]).sum(axis=2)
                                for i in range(0, len(near), LEAF)], axis=1)
        open_ = SCALE * bound >= SHARE * (own_sizes[:, None] + least[None, near])
        for j, other in enumerate(near):
            mine = np.flatnonzero(open_[:, j])
            if not len(mine):
                continue
            a, b = first[other], min(first[other] + LEAF, m)
            overlap = np.minimum(own[mine, None, :], points[None, a:b, :]).sum(axis=2)
            hit = SCALE * overlap >= SHARE * (own_sizes[mine, None] + sizes[None, a:b])
            hit &= component[start + mine][:, None] != component[None, a:b]
            hit &= (start + mine)[:, None] < np.arange(a, b)[None, :]
            found += [(int(order[start + mine[i]]), int(order[a + k])) for i, k in zip(*np.nonzero(hit), strict=True)]
    return found


def _points(column: pa.ChunkedArray, n: np.ndarray) -> np.ndarray:
    """The counts per group of sets of n shingles, from what ``sketches`` keeps of them."""
    held = column.to_pylist()
    points = np.zeros((len(held), GROUPS), dtype=np.int32)
    wide, own = np.flatnonzero(n > EXACT), np.flatnonzero(n <= EXACT)
    if len(wide):
        points[wide] = np.frombuffer(b"".join(held[i] for i in wide), dtype="<u2").reshape(-1, GROUPS)
        points[points == FULL] = 1 << 30
    if len(own):
        group = np.frombuffer(b"".join(held[i] for i in own), dtype="<u2") % GROUPS
        points[own] = np.bincount(np.repeat(np.arange(len(own)), n[own]) * GROUPS + group, minlength=len(own) * GROUPS).reshape(-1, GROUPS)
    return points


def possible(pairs: list[tuple[int, int]], n: np.ndarray, column: pa.ChunkedArray) -> list[tuple[int, int]]:
    """The pairs without those of two small sets whose 16 bits of each shingle rule a link out."""
    sets: dict[int, frozenset[int]] = {}

    def bits(i: int) -> frozenset[int]:
        if i not in sets:
            own = np.frombuffer(column[i].as_py(), dtype="<u2").astype(np.int64)
            place = np.arange(len(own))
            fresh = np.concatenate((np.ones(min(len(own), 1), dtype=bool), own[1:] != own[:-1]))
            again = place - np.maximum.accumulate(np.where(fresh, place, 0))  # equal bits of several shingles count apart
            sets[i] = frozenset((own << 16 | again).tolist())
        return sets[i]

    return [(i, j) for i, j in pairs if n[i] > EXACT or n[j] > EXACT or SCALE * len(bits(i) & bits(j)) >= SHARE * (n[i] + n[j])]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by their first column."""
    open_, key = [], None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if open_ and keys[start] != key:
                yield pa.Table.from_batches(open_)
                open_ = []
            key = keys[start]
            open_.append(batch.slice(start, stop - start))
    if open_:
        yield pa.Table.from_batches(open_)


def _found(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Pairs of nodes as a batch, the smaller node first, each pair once."""
    a = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    b = np.concatenate([y for _, y in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
    return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _collected(pairs: Iterator[tuple[np.ndarray, np.ndarray]], enough: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches of pairs; a batch of many trees holds a pair once, however often it met."""
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= enough:
            yield _found(held)
            held, size = [], 0
    yield _found(held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, counts): the middle point of each tree with the points that its bound allows."""
    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for tree in _by_key(batches):
            node, n, points = tree["node"].to_numpy(), tree["n"].to_numpy(), _points(tree["counts"], tree["n"].to_numpy())
            far = np.abs(points - points.mean(axis=0)).sum(axis=1)
            middle = np.lexsort((node, far))[0]
            bound = np.minimum(points, points[middle]).sum(axis=1, dtype=np.int64)
            need = SHARE * (n + n[middle])
            hit = (SCALE * bound >= need) & (SCALE * n >= need) & (SCALE * n[middle] >= need)
            hit[middle] = False
            yield node[hit], np.full(int(hit.sum()), node[middle])

    return _collected(pairs())


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, root, counts): the surviving pairs of each tree."""
    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for tree in _by_key(batches):
            node = tree["node"].to_numpy()
            n = tree["n"].to_numpy()
            found = survivors(n, tree["root"].to_numpy(), _points(tree["counts"], n))
            found = np.array(possible(found, n, tree["counts"]), dtype=np.int64).reshape(-1, 2)
            yield node[found[:, 0]], node[found[:, 1]]

    return _collected(pairs())


def verified(pairs: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the similarity; members is (node, doc_id) of one text each."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = wanted.join(members, "node").select("node", F.col("doc_id").alias("member"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("member"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(text) for text in batch.column(1).to_pylist()]
            node = batch.column(0).to_pylist()
            # an id may have several texts: only the one with the node's hash counts
            keep = [i for i, s in enumerate(own) if int(s.sum(dtype=np.uint64).astype(np.int64)) == node[i]]
            yield pa.record_batch([pa.array([node[i] for i in keep], pa.int64()), pa.array([own[i].tobytes() for i in keep], pa.binary())], names=["node", "items"])

    table = written(texts.select("node", "text").mapInArrow(sets, "node long, items binary").dropDuplicates(["node"]), "ngram-sets")
    left = table.select(F.col("node").alias("a"), F.col("items").alias("left"))
    right = table.select(F.col("node").alias("b"), F.col("items").alias("right"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                if SCALE * int((both[1:] == both[:-1]).sum()) >= SHARE * len(both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(link, "a long, b long")


def linked(documents: DataFrame, hot: int = 256) -> tuple[DataFrame, DataFrame]:
    """All documents as (doc_id, text_hash, n, node), and links (a, b) between nodes that connect what is connected."""
    table = written(sketches(documents), "ngram-sketches")
    full = table.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    points = written(full.groupBy("node").agg(F.min(F.struct("doc_id", "n", "keys", "counts")).alias("p")).select("node", "p.*"), "ngram-points")
    keyed = points.select("node", "n", F.explode("keys").alias("key"))
    of_key = Window.partitionBy("key")
    met = keyed.withColumn("met", F.count(F.lit(1)).over(of_key)).filter("met > 1")
    met = written(met, "ngram-keys")
    warm = met.groupBy("node").agg(F.sum((F.col("met") > hot).cast("int")).alias("hot"))
    cold_only = warm.filter("hot > 0").join(points.select("node", "n"), "node").filter(
        F.col("hot") * 4 <= F.least("n", F.lit(KEYS))).select("node", F.lit(True).alias("cold_only"))
    kept = met.join(cold_only, "node", "left").filter((F.col("met") <= hot) | F.col("cold_only").isNull()).drop("cold_only", "met")
    kept = written(kept.withColumn("met", F.count(F.lit(1)).over(of_key)).filter("met > 1").select("key", "node", "met"), "ngram-met")
    vector, members = points.select("node", "n", "counts"), points.select("node", "doc_id")
    along = lambda rows: rows.join(vector, "node").repartition("key").sortWithinPartitions("key")
    stars = along(kept).select("key", "node", "n", "counts").mapInArrow(_stars, "a long, b long").distinct()
    stars = written(stars, "ngram-stars")
    links = written(verified(stars, members, documents), "ngram-links")
    placed = kept.filter("met > 2").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    span = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    rows = along(placed.join(span, "key", "left_semi")).select("key", "node", "n", "root", "counts")
    more = written(rows.mapInArrow(_trees, "a long, b long").distinct(), "ngram-more")
    more = more.join(stars, ["a", "b"], "left_anti")
    links = links.unionByName(written(verified(more, members, documents), "ngram-links"))
    return table.select("doc_id", "text_hash", "n", "node"), links


def _placed(documents: DataFrame, **options) -> DataFrame:
    """All documents with ``first``, the least (doc_id, text_hash) of their component; null without shingles or id."""
    table, links = linked(documents, **options)
    full = table.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    own = full.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("low"))
    roots = components(links)
    placed = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("first"))
    named = placed.join(lowest, "root").select(F.col("node").alias("of"), "first")
    return table.join(named, (F.col("node") == F.col("of")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")


def grouped(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    both = _placed(documents, **options)
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def copies(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, text_hash) of the documents that are not the first of their component; an id may have several texts."""
    both = _placed(documents, **options)
    return both.filter(F.struct("doc_id", "text_hash") != F.col("first")).select("doc_id", "text_hash").distinct()


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, len(g) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS h FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 175 * k >= 75 * (x.n + y.n)),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id::BIGINT AS component_id
FROM n JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
