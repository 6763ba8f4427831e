"""Whitening of embeddings by a covariance over distinct vectors, each weighted by its multiplicity or by one.

Components are scaled to whole numbers, so equal vectors can be grouped exactly: the
covariance, the audit and the projection run once per distinct vector, however many copies
a vector has, and the rows are joined back at the end.

* Sums per dimension are exact integers; they and the matrix of dimension by dimension are
  all that reaches the driver.
* The covariance is a centred matrix product per task, added up by Spark.
* Whitened coordinates come with an audit: the largest entry of their own covariance minus
  the identity, read from the written result.

A vector that holds a third of all rows is one row behind a map-side count; only the join
back meets its copies, and there Spark splits the rows of the one key.

Defined cases: rows whose vector is null, or holds a null, a NaN or an infinite entry, are
left out; so are vectors of another length than the most frequent one (the shorter at a
tie) and vectors without entries; repeated rows and a null id are kept; numbers beyond
64 bits are cut to the nearest, a deviation beyond them is null; a component without
variance gives null for ``whitened`` (one distinct vector has no other), and no variance
at all null for ``explained``; ties of eigenvalues take the solver's order; an empty table
gives no rows; extra columns are ignored, whatever their names. There are no texts here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opslens.llm.common import bounded_batches, written

SCALE = 256
COMPONENTS = 4
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"
SAFE = 1 << 62
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Model:
    """What a fit leaves: weights in all, exact sums, unit components by falling eigenvalue, and their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def inverse_roots(self) -> np.ndarray:
        """1 / sqrt(eigenvalue), NaN where a component has no variance."""
        least = self.trace * len(self.sums) * np.finfo(float).eps
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > least, 1 / np.sqrt(np.maximum(self.eigenvalues, 0)), np.nan)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """A vector as whole numbers, null where an entry is missing or not finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when((F.size(vector) > 0) & finite, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) of a batch of distinct vectors; all have one length."""
    weights = batch.column("weight").to_numpy()
    return batch.column("x").flatten().to_numpy().reshape(len(weights), -1), weights


def exact_sums(x: np.ndarray, weights: np.ndarray) -> list[int]:
    most = max(int(x.max()), -int(x.min())) * int(weights.max()) * len(x)
    if most < SAFE:
        return [int(s) for s in weights @ x]
    return [int(s) for s in (x.astype(object) * weights.astype(object)[:, None]).sum(axis=0)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 per vector, exact; None beyond 64 bits."""
    most = n * max(int(x.max()), -int(x.min())) + max(abs(s) for s in sums)
    if most < SAFE and most * most * len(sums) < SAFE:
        apart = n * x - np.array(sums, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - np.array(sums, dtype=object)
    return [int(d) if d <= LARGEST else None for d in (apart * apart).sum(axis=1)]


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x, weights = _arrays(batch)
            own = exact_sums(x, weights)
            total = own if total is None else [a + b for a, b in zip(total, own)]
            n += int(weights.sum())
    if total is not None:
        places = [*range(len(total)), -1]  # the weights themselves stand at -1
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([Decimal(s) for s in [*total, n]], pa.decimal128(38, 0))], ["i", "s"])


def _partial_products(mean: np.ndarray):
    """Per task the weighted product of its centred vectors, one row per row of the matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                x, weights = _arrays(batch)
                apart = x - mean
                total += (apart * weights[:, None]).T @ apart
        yield pa.RecordBatch.from_arrays([pa.array(range(len(mean)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "products"])
    return run


def distinct_vectors(vectors: DataFrame, weight: str = "one") -> DataFrame:
    """(x, weight): each vector once, weighted by one or by its number of rows."""
    if weight not in ("one", "count"):
        raise ValueError("weight is 'one' or 'count'")
    copies = F.count(F.lit(1)) if weight == "count" else F.lit(1).cast("long")
    return vectors.groupBy("x").agg(copies.alias("weight"))


def fitted(distinct: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a table of distinct vectors; None if it is empty."""
    sums = {r["i"]: int(r["s"]) for r in distinct.mapInArrow(_partial_sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    if not sums:
        return None
    n = sums.pop(-1)
    each = [sums[i] for i in range(len(sums))]
    mean = np.array([s / n for s in each])
    parts = distinct.mapInArrow(_partial_products(mean), "i int, products array<double>").select("i", F.posexplode("products").alias("j", "p"))
    covariance = np.zeros((len(each), len(each)))
    for r in parts.groupBy("i", "j").agg(F.sum("p").alias("p")).collect():  # dimension by dimension numbers
        covariance[r["i"], r["j"]] = r["p"] / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    largest = np.argsort(values)[::-1][:components]
    chosen = directions[:, largest]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return Model(n, each, chosen * signs, values[largest], float(np.trace(covariance)))


def _projected(model: Model):
    mean, turn = model.mean(), model.components
    roots = model.inverse_roots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, _ = _arrays(batch)
                found = ((x - mean) @ turn) * roots
                rows = [[None if v != v else v for v in row] for row in found.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("weight"), pa.array(deviations(x, model.n, model.sums), pa.int64()),
                                                  pa.array(rows, pa.list_(pa.float64()))], ["x", "weight", "deviation", "whitened"])
    return run


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """The largest entry of the whitened vectors' weighted covariance minus the identity, over components with variance."""
    w, part = F.col("weight"), lambda i: F.get("whitened", F.lit(i))
    means = whitened.agg(*[(F.sum(w * part(i)) / F.sum(w)).alias(f"m{i}") for i in range(components)]).first()
    has = [i for i in range(components) if means[i] is not None]
    if not has:
        return None
    apart = {i: part(i) - F.lit(means[i]) for i in has}
    pairs = [(i, j) for i in has for j in has if i <= j]
    row = whitened.agg(*[(F.sum(w * apart[i] * apart[j]) / F.sum(w)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, row))


def whiten(vectors: DataFrame, column: str = "embedding", id: str = "vec_id", components: int = COMPONENTS, weight: str = "one", scale: int = SCALE) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id}`").alias("id"), whole_numbers(F.col(f"`{column}`"), scale).alias("x")).filter("x is not null")
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    model = None
    if lengths:
        rows = rows.filter(F.size("x") == lengths["length"])
        distinct = written(distinct_vectors(rows, weight), "whiten-distinct")
        model = fitted(distinct, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"`{id}` {dict(vectors.dtypes)[id]}, {RESULT}")
    found = written(distinct.mapInArrow(_projected(model), "x array<long>, weight long, deviation long, whitened array<double>"), "whiten-vectors")
    error = identity_error(found, len(model.eigenvalues))
    shares = [float(e) / model.trace if model.trace > 0 else None for e in model.eigenvalues]
    explained = F.array(*[F.lit(s).cast("double") for s in shares])
    both = rows.join(found, "x").select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return both.select(F.col("id").alias(id), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
