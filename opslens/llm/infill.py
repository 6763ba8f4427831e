"""Fill-in-the-middle: each text is cut in three at line ends and its parts change places.

A batch of texts is one array of bytes. The line ends give the cuts; where a part of a
text moves, its shift enters a difference array at the part's first byte. The running sum
is the shift of every byte, and one numpy scatter writes the whole batch of outputs.
Restoring reads nothing but outputs and forms: the marks found in the outputs give the
parts, their shifts make the inverse gather.

The cuts and the form of a document follow from a hash of the seed and its id, so a run
may be repeated or dealt out anew. Rows do not meet: nothing is shuffled.

Defined cases: a null text is empty; an empty text, and one that holds a mark already,
stays plain; a null id is hashed as an empty string; repeated rows each give their own;
a text longer than a batch makes a batch by itself; an empty table gives no rows; ties do
not arise; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from opslens.llm.common import bounded_batches

#: The marks before prefix, suffix and middle.
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
WIDTH = 3
SEED, RATE, SPM_RATE = 7, 100, 50
FORMS = np.array(["plain", "psm", "spm"], dtype=object)
PLAIN, PSM, SPM = range(3)
ROWS = "n long, form string, prefix_chars long, middle_chars long, output string"


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch, and where each text begins (and the last ends)."""
    texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def _texts(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(raw)))


def _marked(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of marks that lie within one text, and the texts' numbers."""
    if len(raw) < WIDTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first, kind, last = raw[:-2], raw[1:-1], raw[2:]
    place = np.flatnonzero((first == MARKS["P"][0]) & (last == MARKS["P"][2]) & np.isin(kind, [m[1] for m in MARKS.values()]))
    text = np.searchsorted(at, place, side="right") - 1
    inside = place + WIDTH <= at[text + 1]
    return place[inside], text[inside]


def _shifts(length: int, begins: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The shift of every byte, from parts in order: where each begins and how far it moves."""
    steps = np.zeros(length + 1, dtype=np.int64)
    np.add.at(steps, begins, np.diff(moves, prepend=0))  # an empty part and the next one begin alike: both steps add up
    return np.cumsum(steps[:length])


def cut_batch(raw: np.ndarray, at: np.ndarray, h: list[np.ndarray], rate: int = RATE, spm_rate: int = SPM_RATE):
    """(lines, form, first cut, second cut) per text; cuts are places in the batch."""
    starts, ends = at[:-1], at[1:]
    feeds = np.flatnonzero(raw == 10)
    before, through = np.searchsorted(feeds, starts), np.searchsorted(feeds, ends)
    filled = ends > starts
    open_end = filled.copy()
    open_end[filled] = raw[ends[filled] - 1] != 10
    n = through - before + open_end
    padded = np.append(feeds + 1, 0)  # behind each line feed

    def place(units: np.ndarray) -> np.ndarray:
        behind = padded[np.clip(before + units - 1, 0, len(padded) - 1)]
        return np.where(units == 0, starts, np.where(units > through - before, ends, behind))

    one, two = h[0] % (n + 1), h[1] % (n + 1)
    plain = ~filled | (h[2] % 100 >= rate)
    plain[_marked(raw, at)[1]] = True
    form = np.where(plain, PLAIN, np.where(h[3] % 100 < spm_rate, SPM, PSM))
    return n, form, place(np.minimum(one, two)), place(np.maximum(one, two))


def scatter(raw: np.ndarray, at: np.ndarray, form: np.ndarray, cut1: np.ndarray, cut2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of a batch as bytes and offsets."""
    starts, ends, moved = at[:-1], at[1:], form != PLAIN
    out_at = np.concatenate(([0], np.cumsum(ends - starts + 3 * WIDTH * moved)))
    begin, prefix, suffix = out_at[:-1], cut1 - starts, ends - cut2
    mark_p = begin + np.where(form == SPM, WIDTH + suffix, 0)
    mark_s = begin + np.where(form == SPM, 0, WIDTH + prefix)
    mark_m = begin + 2 * WIDTH + prefix + suffix
    to = np.stack([np.where(moved, mark + WIDTH, begin + own - starts) for mark, own in ((mark_p, starts), (mark_m, cut1), (mark_s, cut2))], axis=1)
    parts = np.stack([starts, cut1, cut2], axis=1)
    out = np.empty(out_at[-1], dtype=np.uint8)
    out[np.arange(len(raw)) + _shifts(len(raw), parts.ravel(), (to - parts).ravel())] = raw
    for name, mark in (("P", mark_p), ("S", mark_s), ("M", mark_m)):
        for i in range(WIDTH):
            out[mark[moved] + i] = MARKS[name][i]
    return out, out_at


def gather(out: np.ndarray, out_at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts back from outputs and forms alone."""
    begin, ends, moved = out_at[:-1], out_at[1:], form != PLAIN
    at = np.concatenate(([0], np.cumsum(ends - begin - 3 * WIDTH * moved)))
    place, text = _marked(out, out_at)
    place, text = place[moved[text]], text[moved[text]]
    mark = {}
    for name, code in MARKS.items():
        mark[name] = begin.copy()
        own = out[place + 1] == code[1]
        mark[name][text[own]] = place[own]
    prefix = np.where(moved, np.where(form == SPM, mark["M"], mark["S"]) - mark["P"] - WIDTH, 0)
    middle = np.where(moved, ends - mark["M"] - WIDTH, 0)
    starts = at[:-1]
    parts = np.stack([starts, starts + prefix, starts + prefix + middle], axis=1)
    source = np.stack([np.where(moved, mark[name] + WIDTH, begin) for name in "PMS"], axis=1)
    shift = _shifts(at[-1], parts.ravel(), (source - parts).ravel())
    return out[np.arange(at[-1]) + shift], at


def _transform(rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = _bytes(batch.column("text"))
            n, form, cut1, cut2 = cut_batch(raw, at, [batch.column(f"h{i}").to_numpy() for i in range(1, 5)], rate, spm_rate)
            out, out_at = scatter(raw, at, form, cut1, cut2)
            points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            plain = form == PLAIN
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(FORMS[form], pa.string()), pa.array(points[cut1] - points[at[:-1]], pa.int64(), mask=plain),
                 pa.array(points[cut2] - points[cut1], pa.int64(), mask=plain), _texts(out, out_at)],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = {name: code for code, name in enumerate(FORMS)}
    for batch in batches:
        out, out_at = _bytes(batch.column("output"))
        form = np.array([codes[f] for f in batch.column("form").to_pylist()], dtype=np.int64)
        restored = _texts(*gather(out, out_at, form))
        yield pa.RecordBatch.from_arrays([*batch.columns, restored], [*batch.schema.names, "restored"])


def _draws(id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transformed(documents: DataFrame, id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """id, n lines, form, prefix_chars, middle_chars and the output of every document.

    Of 100 documents ``rate`` are cut, and ``spm_rate`` of 100 of these have the suffix first.
    """
    bounded_batches(documents.sparkSession, size="4m")  # some numbers of 8 bytes are held per byte of a batch
    own = F.col(f"`{id}`")
    rows = documents.select(own.alias("id"), F.col(f"`{text}`").alias("text"), *_draws(own, seed))
    return rows.mapInArrow(_transform(rate, spm_rate), f"id {dict(documents.dtypes)[id]}, {ROWS}").withColumnRenamed("id", id)


def restored(found: DataFrame) -> DataFrame:
    """Adds ``restored``, rebuilt from the columns ``output`` and ``form``."""
    bounded_batches(found.sparkSession, size="4m")
    return found.mapInArrow(_restore, T.StructType([*found.schema.fields, T.StructField("restored", T.StringType())]))


RESULT = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def digests(documents: DataFrame) -> DataFrame:
    """The outputs and what they restore to, as hashes."""
    found = restored(transformed(documents))
    return found.withColumns({"output_sha256": F.sha2(F.col("output").cast("binary"), 256), "restored_sha256": F.sha2(F.col("restored").cast("binary"), 256)}).select(*RESULT)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
c AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
             ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT doc_id, t, l, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT doc_id, t, n, form, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:n], '') AS s FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
