"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity; two sets with a Jaccard
similarity of at least 0.8 share a word among the rarest n - ceil(0.8 n) + 1 of each. Where
such a prefix word is in at most ``CROWD`` lines it is a key, so that a key's lines are few.

Other words are keys only together. Sets of n and m words that are that similar differ in
at most K = (n + m) / 9 words. If they share no rare word, all their rare words, u of one
set and v of the other, are among these, and their crowded words differ in at most K - u - v.
The crowded words are dealt by hash into more than K parts; with the parts of a line ordered
by how rare their words are, the K - u + 1 and K - v + 1 rarest have a part in common. These
parts are the other keys. K comes from a ladder, rounded up, so that a line has parts for
one to three steps; one whose words lie in fewer parts than that has its crowded prefix
words as keys, too, which only meet those of other such lines.

Lines that share a key and pass the filters by size and image are verified on their whole
sets. A line goes when an earlier line, by doc_id and place in the text, is that similar;
exactness does not depend on how well the rarity is known.

Rarity comes from a table of 2^24 hashed counts over all lines, kept as one byte each:
16 MB whatever the corpus. A word whose count is one is in no other line and is not
looked up at all.

Equal sets are one class, of which the earliest line stays; classes are numbered in the
order of these lines, so that the smaller number is the earlier line. For a class it is
enough to find one earlier similar line. So under each key a class first names up to
``TRIED`` earlier ones that may be similar, the key's earliest first: a group of near copies
is settled by its first line. Only classes that are still there and may have further similar
ones under a key are held against its other lines, set by set inside the key, so that no
step gives more rows than lines have keys. Sets are fetched only for lines whose images
allow the overlap: words fall into 128 places, or 64 for sets of up to ``WIDE``, and the
parities of two sets differ in no more places than the sets differ in words.

Defined cases: a null or empty text has no lines; a line with fewer than ``least`` words,
repeated ones counted, is left alone; rows with the same id and text are one document and give one row; texts
of one id are ordered by hash, a null id comes first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from opslens.llm.common import bounded_batches, written
from opslens.llm.ngram_join import _by_key as by_key
from opslens.llm.shingles import folded, mixed, placed_words

BUCKETS, CHUNK = 1 << 24, 1 << 16
#: Linked when SCALE * overlap >= SHARE * (size + size): a similarity of 4 / 5.
SCALE, SHARE = 9, 4
LEAST = 3
BLOOM = 1 << 20
CROWD_LEVEL = 8 * 9  # the level of a count of 512, CROWD
#: A smaller set is that similar to no set but itself, which its class tells: 9 a >= 4 (a + a + 1) takes four words.
APART = 4
#: Steps of K, the number of words in which two sets may differ.
LADDER = np.array([1, 2, 3, 4, 5, 6, *[int(6 * 1.3 ** i) for i in range(1, 80)]], dtype=np.int64)
TEXTS = 1 << 17  # characters of texts whose words are found together
TRIED = 3  # earlier lines that a line is compared with per key before it is known which lines are gone
WIDE = 64  # words of the largest set of which only 64 sums of the image travel
TOGETHER = 1 << 18  # rows of keys that are paired together
#: A line under one of its keys, of which the first bits are kept; ``high`` goes beside it for sets of more than ``WIDE`` words.
ROW = np.dtype([("key", "<u8"), ("id", "<i8"), ("n", "<u4"), ("low", "<u8")])
KEY_BITS = 40


def line_sets(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line with words: (line number, start in words, sorted word hashes), and how many words it has in all."""
    raw = folded(text)
    words, at = placed_words(raw)
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
    line = np.searchsorted(ends, at)
    if len(line) and line[-1] < 1 << 16:  # line and 48 bits of the word in one number sort several times faster
        order = np.argsort((line.astype(np.uint64) << np.uint64(48)) | (words >> np.uint64(16)))
    else:
        order = np.lexsort((words, line))
    line, words = line[order], words[order]
    total = np.unique(line, return_counts=True)[1]
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
    line, words = line[fresh], words[fresh]
    start = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, dtype=np.int64)
    return line[start], start, words, total


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts one after the other, null ones as empty, up to about ``TEXTS`` characters together."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size > TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _ranked(which: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order by ``which``, then ``first``, then ``second``; in one number where they fit, which sorts several times faster."""
    if len(which) and which.max() < 1 << 24 and first.max() < 1 << 20 and second.max() < 1 << 20:
        return np.argsort((which.astype(np.uint64) << np.uint64(40)) | (first.astype(np.uint64) << np.uint64(20)) | second.astype(np.uint64))
    return np.lexsort((second, first, which))


def line_keys(words: np.ndarray, which: np.ndarray, n: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of sets of words: ``which`` is the line of each word, in order, ``n`` a line's size, ``common`` a word's level."""
    if not len(n):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    prefix = n - (SHARE * n + SCALE - SHARE - 1) // (SCALE - SHARE) + 1
    begin = np.cumsum(n) - n
    order = _ranked(which, common.astype(np.int64), np.arange(len(words)) - begin[which])
    words, common = words[order], common[order]  # by line and rarity
    early = np.arange(len(words)) - begin[which] < prefix[which]
    crowded = common > CROWD_LEVEL
    single = early & ~crowded & (common > 1)
    found = [(which[single], words[single])]
    rare = n - np.bincount(which, crowded, len(n)).astype(np.int64)
    low = np.searchsorted(LADDER, (n + (SHARE * n + SCALE - SHARE - 1) // (SCALE - SHARE)) // SCALE)
    high = np.searchsorted(LADDER, (n + (SCALE - SHARE) * n // SHARE) // SCALE)
    for step in range(int((high - low).max()) + 1):
        most = LADDER[low + step]
        lines = np.flatnonzero((low + step <= high) & (rare < prefix) & (rare <= most))
        if not len(lines):
            continue
        most, needed = most[lines], most[lines] - rare[lines] + 1
        parts = most + 1 + (most + 3) // 3
        first = np.cumsum(parts) - parts
        place = np.full(len(n), -1)
        place[lines] = np.arange(len(lines))
        at = np.flatnonzero(crowded & (place[which] >= 0))
        own, w = place[which[at]], words[at]
        slot, slots = first[own] + ((w >> np.uint64(8)) % parts[own].astype(np.uint64)).astype(np.int64), int(parts.sum())
        total = (np.bincount(slot, w & np.uint64((1 << 32) - 1), slots).astype(np.uint64)
                 + (np.bincount(slot, w >> np.uint64(32), slots).astype(np.uint64) << np.uint64(32)))
        known = np.minimum(np.bincount(slot, 256 - common[at].astype(np.int64), slots).astype(np.int64), (1 << 20) - 1)
        line = np.repeat(np.arange(len(lines)), parts)
        number = np.arange(slots) - first[line]
        order = _ranked(line, (1 << 20) - 1 - known, number)  # parts without words come last
        # a line has its slots at the same places before and after the sort
        chosen = order[(number < needed[line]) & (known[order] > 0)]
        salt = (most[line[chosen]].astype(np.uint64) << np.uint64(32)) + number[chosen].astype(np.uint64)
        found.append((lines[line[chosen]], mixed(total[chosen] + mixed(salt))))
        poor = np.bincount(line, known > 0, len(lines)) < needed
        at, own = at[poor[own] & early[at]], own[poor[own] & early[at]]
        found.append((which[at], mixed(words[at] ^ mixed(most[own].astype(np.uint64) + np.uint64(1 << 63)))))
    line, key = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(line, kind="stable")
    return line[order], key[order]


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.xxhash64(F.col("text").isNull(), "text").alias("text_hash"), "text")


def rarity(documents: DataFrame) -> np.ndarray:
    """One byte per bucket of word hashes: 0 none, 1 a single line, else 8 times the binary logarithm of the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            bucket, n = np.unique(np.concatenate(seen), return_counts=True)
            cuts = np.flatnonzero(np.diff(bucket // CHUNK)) + 1
            chunk = [int(b[0]) // CHUNK for b in np.split(bucket, cuts)]
            place = [(b % CHUNK).astype("<u2").tobytes() for b in np.split(bucket, cuts)]
            counts = [c.astype("<u4").tobytes() for c in np.split(n, cuts)]
            return pa.record_batch([pa.array(chunk, pa.int32()), pa.array(place, pa.binary()), pa.array(counts, pa.binary())], names=["chunk", "place", "counts"])

        for batch in batches:
            for texts in _groups(batch.column(0).to_pylist()):
                words, _ = placed_words(folded("\n".join(texts)))  # every occurrence: never fewer than the lines that hold the word
                seen.append((words & np.uint64(BUCKETS - 1)).astype(np.uint32))
                size += len(words)
                if size > 4_000_000:
                    yield counted()
                    seen, size = [], 0
        if size:
            yield counted()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, place, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                total = totals.setdefault(chunk, np.zeros(CHUNK, dtype=np.int64))
                total[np.frombuffer(place, dtype="<u2")] += np.frombuffer(counts, dtype="<u4")
        if totals:
            level = [np.minimum(255, np.where(t < 2, t, np.rint(8 * np.log2(np.maximum(t, 2))))).astype(np.uint8).tobytes() for t in totals.values()]
            yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array(level, pa.binary())], names=["chunk", "level"])

    parts = documents.select("text").mapInArrow(run, "chunk int, place binary, counts binary")
    table = np.zeros(BUCKETS, dtype=np.uint8)
    for row in parts.repartition("chunk").mapInArrow(added, "chunk int, level binary").toLocalIterator():
        table[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] = np.frombuffer(row["level"], dtype=np.uint8)
    return table


LINE = "doc_id long, text_hash long, line long, n long, node long, low long, high long, keys array<long>"

def line_table(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """A row per line with words: its set's size, hash and image, and its keys.

    A document without such lines gives one row with a null line. Lines under ``least`` words have no hash.
    """
    spark = documents.sparkSession
    levels = spark.sparkContext.broadcast(rarity(documents))  # 2^24 bytes
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int64()), ("n", pa.int64()), ("node", pa.int64()),
                        ("low", pa.int64()), ("high", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def keyed(texts: list[str], level: np.ndarray) -> list[np.ndarray]:
        """Columns of the lines of some texts, with the places of the texts first; a text without lines has a row of its own, with line -1."""
        line, start, words, total = line_sets("\n".join(texts))
        begin = np.cumsum([0] + [text.count("\n") + 1 for text in texts])
        row = np.searchsorted(begin, line, side="right") - 1
        none = np.setdiff1d(np.arange(len(texts)), row)
        nothing = [none, np.full(len(none), -1), *[np.zeros(len(none), dtype=np.int64)] * 6, np.zeros(0, dtype=np.int64)]
        if not len(line):
            return nothing
        line = line - begin[row]
        n = np.diff(np.append(start, len(words)))
        node = np.add.reduceat(words, start).astype(np.int64)
        bit = words >> np.uint64(57)  # 7 bits that the buckets do not use
        one = np.uint64(1) << (bit & np.uint64(63))
        low = np.bitwise_xor.reduceat(one, start).astype(np.int64)
        high = np.bitwise_xor.reduceat(np.where(bit < 64, np.uint64(0), one), start).astype(np.int64)
        high[n <= WIDE] = 0
        asked = (n >= APART) & (total >= least)
        inside = np.repeat(asked, n)
        own = words[inside]
        of, keys = line_keys(own, np.repeat(np.arange(int(asked.sum())), n[asked]), n[asked], level[(own & np.uint64(BUCKETS - 1)).astype(np.int64)])
        kept = np.zeros(len(n), dtype=np.int64)
        kept[asked] = np.bincount(of, minlength=int(asked.sum()))
        found = [row, line, n, node, low, high, total, kept, keys.astype(np.int64)]
        return [np.concatenate(c) for c in zip(found, nothing, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            found, place = [], 0
            for texts in _groups(batch.column(2).to_pylist()):
                found.append(keyed(texts, level))
                found[-1][0] += place
                place += len(texts)
            if not found:
                continue
            row, line, n, node, low, high, total, kept, keys = [np.concatenate(c) for c in zip(*found, strict=True)]
            row = pa.array(row)
            offsets = pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32())
            short = (total < least) | (line < 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(line, pa.int64(), mask=line < 0), pa.array(n, pa.int64()),
                 pa.array(node, pa.int64(), mask=short), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64()))], schema=schema)

    return _keyed(documents).mapInArrow(run, LINE)


def whole_sets(wanted: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, items): the sets of words of the classes that are asked for by id."""
    lines = (classes.join(wanted, "id", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
             .agg(F.collect_list(F.struct("line", "id")).alias("lines")))
    # most texts are not asked for; at most BLOOM hashes of those that are keep the others out of the shuffle
    mark = lambda i, h: F.pmod(F.xxhash64(i, h), F.lit(BLOOM))
    marks = F.broadcast(lines.select(mark("d", "h").alias("mark")).distinct())
    texts = _keyed(documents)
    texts = texts.join(marks, mark("doc_id", "text_hash") == F.col("mark"), "left_semi").join(lines, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items = [], []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line, start, words, _ = line_sets(text)
                stop = np.append(start[1:], len(words))
                for one in asked:
                    i = int(np.searchsorted(line, one["line"]))
                    ids.append(one["id"])
                    items.append(words[start[i]:stop[i]].tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], names=["id", "items"])

    return written(texts.select("text", "lines").mapInArrow(sets, "id long, items binary").dropDuplicates(["id"]), "line-sets")


def verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity."""
    table = whole_sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), classes, documents)
    left = table.select(F.col("id").alias("a"), F.col("items").alias("left"))
    right = table.select(F.col("id").alias("b"), F.col("items").alias("right"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                both = np.concatenate((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)))
                both.sort()
                if SCALE * int((both[1:] == both[:-1]).sum()) >= SHARE * len(both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(link, "a long, b long")


def _possible(a: str, b: str) -> Column:
    """The length filter and the bound by the images of the two sets, for columns of two lines."""
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c(a, "n") + c(b, "n")
    low, high = c(a, "low").bitwiseXOR(c(b, "low")), c(a, "high").bitwiseXOR(c(b, "high"))
    apart = F.when((c(a, "n") > WIDE) & (c(b, "n") > WIDE), F.bit_count(low.bitwiseXOR(high)) + F.bit_count(high)).otherwise(F.bit_count(low))
    return (F.abs(c(a, "n") - c(b, "n")) * (2 * SHARE + 1) <= total) & (apart * (2 * SHARE + 1) <= total)


def _dealt(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, low, high, keys) as rows of a key each, dealt into chunks of neighbouring keys.

    A chunk's rows travel together, byte by byte: the first bytes of all, the second ones and so on.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def sent() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table["keys"].combine_chunks()
        row = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
        key = keys.flatten().to_numpy().view(np.uint64) >> np.uint64(64 - KEY_BITS)  # a clash only means more pairs to look at
        order = np.argsort(key)
        row, key = row[order], key[order]
        rows = np.empty(len(key), dtype=ROW)
        rows["key"] = key
        for name in ("id", "n", "low"):
            rows[name] = table[name].to_numpy()[row]
        high = table["high"].to_numpy().view(np.uint64)[row]
        chunk = (key * np.uint64(chunks)) >> np.uint64(KEY_BITS)
        cuts = np.concatenate(([0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(key)]))
        parts, wide = [], []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            parts.append(rows[i:j].view(np.uint8).reshape(-1, ROW.itemsize).T.tobytes())
            wide.append(high[i:j][rows["n"][i:j] > WIDE].tobytes())
        return pa.record_batch([pa.array(chunk[cuts[:-1]].astype(np.int32)), pa.array(parts, pa.binary()), pa.array(wide, pa.binary())], names=["chunk", "rows", "wide"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(4).flatten())
        if size > 2 * TOGETHER:
            yield sent()
            held, size = [], 0
    if held:
        yield sent()


def tried(key: np.ndarray, ids: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, key, more): for each row of a key up to ``TRIED`` earlier ones that may be similar, and whether there are others.

    The earliest row of the key comes first, so that near copies name the same one; then come the nearest ones.
    """
    order = np.lexsort((ids, key))
    sorted_key = key[order]
    start = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    met = np.diff(np.append(start, len(key)))
    order = order[np.repeat(met > 1, met)]
    met = met[met > 1]
    key, ids, n, low, high = key[order], ids[order], n[order].astype(np.int32), low[order], high[order]
    place = np.arange(len(ids)) - np.repeat(np.cumsum(met) - met, met)
    hits = np.zeros(len(ids), dtype=np.int64)
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    apart = np.int32(2 * SHARE + 1)

    def look(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> None:
        other = n[a]
        near = np.flatnonzero(np.abs(other - size) * apart <= other + size)
        a, b, total = a[near], b[near], other[near] + size[near]
        narrow = low[a] ^ low[b]
        near = np.flatnonzero(np.bitwise_count(narrow) * apart <= total)
        a, b, total, narrow = a[near], b[near], total[near], narrow[near]
        wide = high[a] ^ high[b]
        near = (n[a] <= WIDE) | (n[b] <= WIDE) | ((np.bitwise_count(narrow ^ wide) + np.bitwise_count(wide)) * apart <= total)
        a, b = a[near], b[near]
        new = hits[b] < TRIED
        found.append((a[new], b[new]))
        hits[b] += 1

    later = np.argsort(-place, kind="stable")  # the rows with many earlier ones first
    later = later[:len(later) - len(met)]
    look(later - place[later], later, n[later])
    for back in range(1, int(met.max(initial=1))):
        if back % 16 == 1:
            later = later[hits[later] <= TRIED]
            depth, size = -place[later], n[later]
        active = int(np.searchsorted(depth, -back))
        if not active:
            break
        look(later[:active] - back, later[:active], size[:active])
    a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return ids[a], ids[b], key[b].astype(np.int64), hits[b] > TRIED


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, rows, wide) in order of their chunks, as pairs (a, b, key); the key is -1 unless b has further ones there."""
    held: list[np.ndarray] = []
    wide: list[np.ndarray] = []
    size, last = 0, None

    def pairs() -> pa.RecordBatch:
        rows = np.concatenate(held)
        high = np.zeros(len(rows), dtype=np.uint64)
        high[rows["n"] > WIDE] = np.concatenate(wide)
        a, b, key, more = tried(*(rows[name] for name in ROW.names), high)
        key = np.where(more, key, -1)
        order = np.lexsort((key, b, a))
        a, b, key = a[order], b[order], key[order]
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (key[1:] != key[:-1])
        return pa.record_batch([pa.array(a[fresh]), pa.array(b[fresh]), pa.array(key[fresh])], names=["a", "b", "key"])

    for batch in batches:
        for chunk, rows, high in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if chunk != last and size > TOGETHER:
                yield pairs()
                held, wide, size = [], [], 0
            last = chunk
            planes = np.frombuffer(rows.as_buffer(), dtype=np.uint8).reshape(ROW.itemsize, -1)
            held.append(np.ascontiguousarray(planes.T).view(ROW).ravel())
            wide.append(np.frombuffer(high.as_py(), dtype="<u8"))
            size += len(held[-1])
    if held:
        yield pairs()


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, asked, items) in order of key and id: the ids of asked rows that are similar to an earlier row of their key."""
    for group in by_key(batches):
        asked, items = group["asked"].to_numpy(), group["items"].to_pylist()
        n = np.array([len(i) // 8 for i in items])
        words, begin = np.frombuffer(b"".join(items), dtype=np.uint64), np.cumsum(n) - n
        found = []
        for i in np.flatnonzero(asked[1:]) + 1:
            own = np.sort(words[begin[i]:begin[i] + n[i]])
            earlier = words[:begin[i]]
            same = own[np.minimum(np.searchsorted(own, earlier), len(own) - 1)] == earlier
            if (SCALE * np.add.reduceat(same, begin[:i], dtype=np.int64) >= SHARE * (n[:i] + n[i])).any():
                found.append(i)
        yield group.select(["id"]).take(pa.array(found, pa.int64())).combine_chunks().to_batches()[0] if found else pa.record_batch([pa.array([], pa.int64())], names=["id"])


ORDER = ["doc_id", "text_hash", "line"]


def judged(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text_hash, line, stays): every line with words, and once more with ``stays`` if it is not removed.

    A document without such lines has rows with a null line.
    """
    bounded_batches(documents.sparkSession)
    table = written(line_table(documents, least).withColumn("uid", F.monotonically_increasing_id()), "line-table")
    whole = table.filter("node is not null")
    # classes are found and numbered on narrow rows; the keys follow once, by the row of the earliest line
    first = whole.groupBy("node").agg(F.min(F.struct(*ORDER, "uid")).alias("first")).select("node", "first.*")
    numbered = first.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("uid", F.monotonically_increasing_id().alias("id"))
    numbered = written(numbered, "line-numbers")  # ids are in the order of the lines
    keys = whole.filter(F.size("keys") > 0).select("uid", "n", "low", "high", "keys")
    classes = written(whole.join(numbered, "uid").select("id", *ORDER), "line-classes")
    chunks = max(1024, numbered.count() >> 12)
    dealt = keys.join(numbered, "uid").select("id", "n", "low", "high", "keys").mapInArrow(lambda b: _dealt(b, chunks), "chunk int, rows binary, wide binary")
    met = written(dealt.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_tried, "a long, b long, key long"), "line-met")
    pairs = written(met.select("a", "b").distinct(), "line-pairs")
    gone = written(verified(pairs, classes, documents).select(F.col("b").alias("id")).distinct(), "line-gone")
    # a class that is still there meets the further ones of its keys, also those that are gone
    open_ = met.filter("key >= 0").select(F.col("b").alias("id"), "key").distinct()
    open_ = written(open_.join(gone, "id", "left_anti"), "line-open")
    wanted = written(open_.select("key").distinct(), "line-wanted")
    rest = keys.select("uid", "n", "low", "high", F.explode("keys").alias("key")).withColumn("key", F.shiftrightunsigned("key", 64 - KEY_BITS))
    rest = written(rest.join(wanted, "key", "left_semi"), "line-rest")  # small as a rule, so that the joins need no shuffle
    rest = written(rest.join(numbered, "uid").drop("uid"), "line-rest")
    asked = rest.join(open_, ["id", "key"], "left_semi")
    both = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & _possible("a", "b")
    others = rest.alias("a").join(asked.alias("b"), both, "left_semi")
    # only a row per line and key travels on, not one per pair
    rest = others.select("key", "id", F.lit(False).alias("asked")).unionByName(asked.select("key", "id", F.lit(True).alias("asked")))
    rest = written(rest.groupBy("key", "id").agg(F.max("asked").alias("asked")), "line-rest")
    rest = rest.join(whole_sets(rest.select("id").distinct(), classes, documents), "id").select("key", "id", "asked", "items")
    more = rest.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_settled, "id long")
    gone = gone.unionByName(written(more.distinct(), "line-gone")).distinct()
    left = classes.join(gone, "id", "left_anti").select(*ORDER).unionByName(table.filter("node is null").select(*ORDER))
    return table.select(*ORDER, F.lit(False).alias("stays")).unionByName(left.select(*ORDER, F.lit(True).alias("stays")))


def removed_lines(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, text_hash, n_lines with words, n_removed, and the removed line numbers in order."""
    own = judged(documents, least).groupBy("doc_id", "text_hash").agg(
        F.collect_set("line").alias("all"), F.collect_set(F.when(F.col("stays"), F.col("line"))).alias("left"))
    return own.withColumn("removed", F.sort_array(F.array_except("all", "left"))).select(
        "doc_id", "text_hash", F.size("all").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def cleaned(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without their removed lines; a document that lost all its lines goes."""
    found = removed_lines(documents, least).filter("n_removed > 0").select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n_lines", "n_removed", "removed")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")  # names of the columns may be any
    own = documents.select(row, F.col("doc_id").alias("id"), F.xxhash64(F.col("text").isNull(), "text").alias("h_own"))
    both = own.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("h_own") == F.col("h")), "left")
    both = both.filter("n_removed is null or n_removed < n_lines")
    left = F.filter(F.split("row.text", "\n", -1), lambda l, i: ~F.array_contains("removed", i.cast("long")))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])
