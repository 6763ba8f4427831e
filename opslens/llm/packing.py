"""Packing along a space-filling curve.

Each document is tokenized once; its token counts, hashed into ``buckets``, are centred,
projected to three dimensions by fixed random directions, and placed on a grid whose
cells a Hilbert curve numbers. The tokens are written, range-sorted by that number and
laid end to end: every task fills sequences from its stretch of the curve and cuts
documents where a sequence is full. The rest at the end of a stretch is cut into
sequences of falling powers of two, so nothing is padded.

A hot group of copies has one curve number; the range sort also looks at a hash of the
id and at the place of the row, so such a group is spread over as many tasks as it needs.

Defined cases: a null text is empty; an empty document is the closing id alone; repeated
rows are packed each; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from opslens.llm.common import bounded_batches, kept, written

CLOSING = 1
LENGTH = 2048
DIMENSIONS, BITS = 3, 10
CACHED = 700_000
PLAIN = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
#: A word of letters with marks behind it: the tokenizer treats the two parts apart.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*#$%&]*)")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTokens:
    """Token ids of texts, with those of words kept.

    White space ends a token of this tokenizer and is dropped, so the ids of a text are
    those of its words, one after the other. A word of plain letters is handed to the
    tokenizer's model as it stands, lower-cased and in the byte alphabet; every other
    word takes the whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size()
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {ord(c): letters.pre_tokenize_str(c)[0][0] for c in PLAIN}
        self.known: dict[str, bytes] = {}

    def _bytes(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, words: set[str]) -> None:
        known, model, marks, whole = self.known, self.tokenizer.model, [], []
        simple = []
        for word in words:
            m = SIMPLE.fullmatch(word)
            if not m:
                whole.append(word)
                continue
            stem, mark = m[1].lower(), m[2]
            if stem not in known:
                spelled = stem if stem.isascii() else stem.translate(self.alphabet)
                known[stem] = self._bytes([t.id for t in model.tokenize(spelled)])
            if mark and mark not in known:
                marks.append(mark)
            simple.append((word, stem, mark))
        rest = list(dict.fromkeys(marks)) + whole
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[word] = self._bytes(found.ids)
        for word, stem, mark in simple:
            known[word] = known[stem] + known[mark] if mark else known[stem]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of ``kind``."""
        found, known = [], self.known
        for text in texts:  # one by one, so that what is kept stays bounded for any batch
            words = text.replace("\n", " ").split(" ")
            new = {word for word in words if word not in known}
            if new:
                if len(known) + 2 * len(new) > CACHED:
                    known.clear()
                    new = set(words)
                self._learn(new)
            found.append(b"".join([known[word] for word in words]))
        return found


def tokens(path: str) -> WordTokens:
    return kept(f"tokens {path}", lambda: WordTokens(path))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (the transpose form, bit by bit)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


class Curve:
    """Curve numbers of token counts: hash, centre, project, grid."""

    def __init__(self, vocabulary: int, buckets: int = 256, seed: int = 5, spread: float = 1.0):
        random = np.random.default_rng(seed)
        self.bucket = random.integers(0, buckets, vocabulary)
        self.directions = random.normal(size=(buckets, DIMENSIONS))
        self.buckets, self.spread = buckets, spread

    def vector(self, ids: np.ndarray) -> np.ndarray:
        counts = np.log1p(np.bincount(self.bucket[ids], minlength=self.buckets))
        counts -= counts.mean()
        norm = np.sqrt((counts * counts).sum())
        return counts / norm if norm else counts

    def places(self, vectors: np.ndarray) -> np.ndarray:
        near = np.tanh(vectors @ self.directions / self.spread)
        return hilbert(np.clip(((near + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def tokenized(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n, place) of every document; ids end with the closing id."""
    bounded_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path)
        closing = np.array([CLOSING], dtype=own.kind).tobytes()
        curve = Curve(own.size)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [found + closing for found in own.encode([text or "" for text in batch.column(1).to_pylist()])]
            arrays = [np.frombuffer(found, dtype=own.kind) for found in ids]
            places = curve.places(np.stack([curve.vector(a) for a in arrays]))
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(a) for a in arrays], pa.int64()),
                                   pa.array(places)], schema=schema)

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, ids binary, n long, place long")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
RESULT = [column.split()[0] for column in PIECE.split(", ")]


def _laid(batches: Iterator[pa.RecordBatch], kind: np.dtype, part: int, length: int) -> Iterator[pa.RecordBatch]:
    """Cuts a stretch of documents into full sequences; the rest at its end into powers of two."""
    sequence = part << 40
    open_, used = [], 0  # the pieces of the sequence that is not full yet: (doc_id, start, words, doc_tokens)
    out: list[tuple] = []

    def close(pieces: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for doc_id, start, words, total in pieces:
            out.append((doc_id, start, len(words), zlib.crc32(words.tobytes()), total, sequence, offset))
            offset += len(words)
        sequence += 1

    def table() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[] for _ in RESULT]
        out.clear()
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=RESULT)

    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = np.frombuffer(ids, dtype=kind).astype("<u4")
            start = 0
            while start < len(words):
                piece = words[start:start + length - used]
                open_.append((doc_id, start, piece, len(words)))
                start, used = start + len(piece), used + len(piece)
                if used == length:
                    close(open_)
                    open_, used = [], 0
        yield table()
    while used:
        room = 1 << (used.bit_length() - 1)
        used -= room
        pieces = []
        while room:
            doc_id, start, words, total = open_[0]
            pieces.append((doc_id, start, words[:room], total))
            if len(words) > room:
                open_[0] = (doc_id, start + room, words[room:], total)
                room = 0
            else:
                room -= len(words)
                open_.pop(0)
        close(pieces)
    yield table()


def pack(documents: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``length`` is a power of two. Sequence ids name a stretch of the curve and a number in it.
    """
    path = path or tokenizer_path()
    kind = tokens(path).kind
    uid = F.monotonically_increasing_id()
    table = written(tokenized(documents, path).withColumn("uid", uid), "pack-tokens")
    order = ["place", F.xxhash64("doc_id"), "uid"]
    along = table.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _laid(batches, kind, TaskContext.get().partitionId(), length)

    return along.mapInArrow(run, PIECE)
