"""Substring dedup by relative Lempel-Ziv parsing: documents are factored against an index of all their blocks.

Every document is part of the reference. A window is ``SPAN`` consecutive words; of the
runs of ``GRAM`` words in it the one with the least hash is its anchor. Consecutive windows
with one anchor form a block, so blocks depend on the words around them only, and a passage
that stands twice is cut into the same blocks but for those at its ends.

1. Index: the blocks of all documents, kept where their anchor stands more than once.
2. Parse: a document is walked from its first block; each block that the index holds
   more than once is a factor (its first other source), and following blocks lengthen
   the factor as long as the same source goes on in the same way.
3. Boundaries: a window at the end of a passage lies in a block of its own document only.
   Blocks whose anchor has other blocks too are therefore checked window by window, one
   block of a kind standing for all its copies.

Words covered by factors, and by windows found at the boundaries, are removed. The result is
exact up to equal 64-bit hashes of anchor and of block or window together; no length of a
document and no number of copies is left out. Copies of a block meet in sums and in joins on
single rows per kind, never among each other.

Defined cases: a null or empty text has no words; a text shorter than a window loses none;
rows with equal id and text are different rows, each the other's copy; a null id is a value
like any other; of equal sources the one with the smallest id, text hash and place counts;
a very long text is parsed whole, in one task; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opslens.llm.common import bounded_batches, written
from opslens.llm.shingles import _power, mixed, placed_words

SPAN, GRAM = 35, 8
MARKS = 1 << 20
_ANCHOR, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
KEY = ["doc_id", "t"]


class Runs:
    """Hashes of runs of words in one text, each from two sums."""

    def __init__(self, text: str | None):
        words, _ = placed_words((text or "").encode("utf-8", "surrogatepass"))
        self.n = len(words)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * _power("up", self.n), dtype=np.uint64))) if self.n else np.zeros(1, dtype=np.uint64)

    def hashes(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        own = (self.sums[starts + lengths] - self.sums[starts]) * _power("down", self.n + 1)[starts]
        return mixed(own + np.asarray(lengths).astype(np.uint64) * _LENGTH)

    def blocks(self, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, block hash, first window, last window) of the blocks in order."""
        none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        windows = self.n - span + 1
        if windows < 1:
            return none
        grams = self.hashes(np.arange(self.n - gram + 1), gram)
        anchor = np.arange(windows) + np.lib.stride_tricks.sliding_window_view(grams, span - gram + 1).argmin(axis=1)
        fresh = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        low, high = np.concatenate(([0], fresh)), np.concatenate((fresh - 1, [windows - 1]))
        at = anchor[low]
        whole = mixed(self.hashes(low, high - low + span) + (at - low).astype(np.uint64) * _ANCHOR)
        return grams[at], whole, low, high


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, rows = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            own = Runs(text).blocks()
            if len(own[0]):
                found.append(own)
                rows.append(np.full(len(own[0]), i))
        if found:
            row = pa.array(np.concatenate(rows))
            anchor, block, low, high = (np.concatenate(part) for part in zip(*found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("t").take(row), _signed(anchor), _signed(block),
                                              pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["doc_id", "t", "h", "u", "low", "high"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the blocks that are asked for."""
    for batch in batches:
        for i, (text, asked) in enumerate(zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist())):
            runs = Runs(text)
            counts = np.array([a["high"] - a["low"] + 1 for a in asked])
            starts = np.concatenate([np.arange(a["low"], a["high"] + 1) for a in asked])
            spread = lambda name: np.repeat(np.array([a[name] for a in asked]), counts)
            row = pa.array(np.full(len(starts), i))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("t").take(row), pa.array(spread("h"), pa.int64()), pa.array(spread("u"), pa.int64()),
                 _signed(runs.hashes(starts, SPAN)), pa.array(starts, pa.int32()), pa.array(spread("single"), pa.bool_())],
                ["doc_id", "t", "h", "u", "w", "low", "single"])


def parsed(spans: list[dict]) -> tuple[list[dict], list[tuple[int, int]]]:
    """Greedy factors of a document, and the merged runs of words (start, end) to remove.

    A span has its first and last window, the id of its source and the word there where it
    starts; no such word means a window that was found at a boundary.
    """
    factors: list[dict] = []
    runs: list[list[int]] = []
    for s in sorted(spans, key=lambda s: (s["low"], s["high"])):
        last, end = (factors[-1] if factors else None), s["high"] + SPAN
        same = last and s["source"] == last["source"] and s["low"] <= last["start"] + last["words"] and (
            s["at"] is None and last["at"] is None or None not in (s["at"], last["at"]) and s["at"] - s["low"] == last["at"] - last["start"])
        if same:
            last["words"] = max(last["words"], end - last["start"])
        else:
            factors.append({"start": s["low"], "words": end - s["low"], "source": s["source"], "at": s["at"]})
        if runs and s["low"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([s["low"], end])
    return factors, [(a, b) for a, b in runs]


FOUND = "n_words long, n_removed long, kept string, factors array<struct<start:long,words:long,source:long,at:long>>"


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            factors, runs = parsed(spans or [])
            kept, at = [], 0
            for start, end in runs:
                kept += words[at:start]
                at = end
            kept += words[at:]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), factors))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "words", "source", "at")]))]
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept", "factors"])


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def _of(side: DataFrame) -> DataFrame:
    """The key of a joined side under names of its own."""
    return side.withColumnsRenamed({"doc_id": "d_", "t": "t_"})


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("t") == F.col("t_"))


def _mark() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(MARKS))


def _marks(side: DataFrame) -> DataFrame:
    """Hashed keys of a side, at most ``MARKS``: keeps texts that are not asked for out of a shuffle."""
    return F.broadcast(side.select(_mark().alias("mark")).distinct())


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, t, spans): per document the blocks and windows that stand elsewhere too, with the source of a block."""
    spark = documents.sparkSession
    bounded_batches(spark, size="16m")
    keyed = _keyed(documents)
    blocks = written(keyed.mapInArrow(_blocks, "doc_id long, t long, h long, u long, low int, high int"), "lz-blocks")
    index = written(blocks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u1"), F.max("u").alias("u2")).filter("n > 1")
                    .select("h", (F.col("u1") != F.col("u2")).alias("open")), "lz-index")
    found = written(blocks.join(index, "h"), "lz-found")
    first = F.min(F.struct("doc_id", "t", "low", "high")).alias("first")
    kinds = written(found.groupBy("h", "u", "open").agg(F.count(F.lit(1)).alias("n"), first), "lz-kinds")
    sources = kinds.filter("n > 1").select("h", "u", F.col("first.doc_id").alias("source"), F.col("first.low").alias("at"))
    factors = found.join(sources, ["h", "u"]).select(*KEY, "low", "high", "source", F.col("at").cast("int"))

    asked = kinds.filter("open").select("first.*", "h", "u", (F.col("n") == 1).alias("single"))
    asked = written(asked.groupBy(*KEY).agg(F.collect_list(F.struct("h", "u", "low", "high", "single")).alias("asked")), "lz-asked")
    texts = keyed.join(_marks(asked), _mark() == F.col("mark"), "left_semi").join(_of(asked), _same()).select(*KEY, "text", "asked")
    windows = written(texts.mapInArrow(_windows, "doc_id long, t long, h long, u long, w long, low int, single boolean"), "lz-windows")
    shared = written(windows.groupBy("h", "w").agg(F.min("u").alias("u1"), F.max("u").alias("u2")).filter("u1 <> u2").select("h", "w"), "lz-shared")
    edges = windows.filter("single").join(shared, ["h", "w"], "left_semi")
    edges = edges.select(*KEY, "low", F.col("low").alias("high"), F.lit(None).cast("long").alias("source"), F.lit(None).cast("int").alias("at"))
    # a row that is there twice has each span twice: once is enough, and bounds the list by the text's own length
    once = factors.unionByName(edges).distinct()
    return written(once.groupBy(*KEY).agg(F.collect_list(F.struct("low", "high", "source", "at")).alias("spans")), "lz-spans")


def cleaned(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its other words, one space between them) and factors.

    A factor has its first word, its number of words, and the id and word where its source
    stands; a factor that was found at a boundary has no source.
    """
    spans = repeated_spans(documents)
    keyed, marks = _keyed(documents), _marks(spans)
    hit = keyed.join(marks, _mark() == F.col("mark"), "left_semi").join(_of(spans), _same(), "left")
    rest = keyed.join(marks, _mark() == F.col("mark"), "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    rows = hit.select("doc_id", "text", "spans").unionByName(rest.select("doc_id", "text", "spans"))
    return rows.mapInArrow(_cleaned, f"doc_id long, {FOUND}")


RESULT = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def digests(documents: DataFrame) -> DataFrame:
    return cleaned(documents).withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).select(*RESULT)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
p AS (SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS w, len(l) AS n FROM d),
g AS (SELECT p.r, i, CASE WHEN i + 34 <= p.n THEN md5(array_to_string(l[i:i + 34], ' ')) END AS g FROM p JOIN d USING (r)),
c AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS again FROM g),
m AS (SELECT r, i, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m JOIN p USING (r, i) GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
