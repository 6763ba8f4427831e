"""Operators on vectors, cuts and repeated passages against brute-force versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from opslens.llm import factoring, infill, whitening

SMALL = "/root/testdata/sf0.001"


# -- whitening ----------------------------------------------------------------------------------

def naive_whitening(vectors, k=4):
    """Rows of (id, vector) -> (n, {id: deviation}, eigenvalues, components, trace, {id: whitened})."""
    x = {i: np.array([math.floor(256 * c) for c in v], dtype=object) for i, v in vectors}
    fit = np.array([list(v) for v in {tuple(v) for v in x.values()}], dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    apart = (fit * n - sums).astype(float) / n
    values, turn = np.linalg.eigh(apart.T @ apart / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    mean = np.array([s / n for s in sums])
    deviation = {i: int((((n * v - sums) ** 2).sum())) for i, v in x.items()}
    return n, deviation, values, turn, float(np.trace(apart.T @ apart / n)), {i: ((v.astype(float) - mean) @ turn) / np.sqrt(values) for i, v in x.items()}


def test_whitening_is_that_of_numpy(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    n, deviation, values, turn, trace, white = naive_whitening(vectors)
    rows = whitening.whiten(table).collect()
    assert len(rows) == 4 * len(vectors)
    by = defaultdict(dict)
    for r in rows:
        by[r["vec_id"]][r["component"]] = r
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
    for c in range(4):
        signs = {round(by[i][c + 1]["whitened"] / white[i][c]) for i, _ in vectors if abs(white[i][c]) > 0.1}
        assert len(signs) == 1
        for i, _ in vectors:
            assert by[i][c + 1]["whitened"] == pytest.approx(signs.copy().pop() * white[i][c], abs=1e-8)


def test_whitening_of_copies_and_odd_vectors(spark):
    make = random.Random(3)
    good = [(i, [make.gauss(0, 1 + j) for j in range(3)]) for i in range(40)]
    copies = [(100 + i, good[0][1]) for i in range(60)] + [(None, good[1][1]), (7, good[7][1])]
    bad = [(200, None), (201, [1.0, None, 0.0]), (202, [math.nan, 0.0, 0.0]), (203, [math.inf, 0.0, 0.0]), (204, []), (205, [1.0])]
    schema = "vec_id long, embedding array<double>, id string, x long, whitened string"
    frame = spark.createDataFrame([(*r, "a", 1, "b") for r in good + copies + bad], schema)
    rows = whitening.whiten(frame).collect()
    assert Counter(r["component"] for r in rows) == dict.fromkeys((1, 2, 3), 102)  # three dimensions have three components
    assert {r["n"] for r in rows} == {40} and max(r["identity_error"] for r in rows) < 1e-9
    _, deviation, *_ = naive_whitening(good)
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in rows if r["vec_id"] in deviation)
    counted = whitening.whiten(frame, weight="count").collect()
    assert {r["n"] for r in counted} == {102} and max(r["identity_error"] for r in counted) < 1e-9
    assert whitening.whiten(frame.limit(0)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None)] * 6


def test_whitening_keeps_exact_numbers_when_they_are_large():
    x = np.array([[2 ** 61, -5], [-2 ** 61, 7]], dtype=np.int64)
    assert whitening.exact_sums(x, np.array([3, 1])) == [2 ** 62, -8]
    assert whitening.deviations(x, 2, [0, 2]) == [None, None]
    assert whitening.deviations(np.array([[3 * 10 ** 6, 1]]), 10, [5, 7]) == [(3 * 10 ** 7 - 5) ** 2 + 9]


# -- infill -------------------------------------------------------------------------------------

def naive_infill(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    lines = text.splitlines(keepends=True) if not set("\r\x0b\x0c\x1c\x1d\x1e\x85  ") & set(text) else [
        part + "\n" for part in text.split("\n")[:-1]] + [part for part in text.split("\n")[-1:] if part]
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (60, 10)])
def test_infill_is_that_of_string_slices(spark, rate, spm_rate):
    make = random.Random(5)
    texts = ["".join(make.choice("ab \n<PSM>é\U0001f600\r") for _ in range(make.randrange(0, 40))) for _ in range(600)]
    texts += [None, "", "\n", "\n\n", "a", "<P", "<P\n>", "x<S>y", "<M>", odd.LONG, "é\n" * 3]
    frame = spark.createDataFrame([(i if i % 50 else None, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, form string, h1 int").repartition(3)
    rows = infill.restored(infill.transformed(frame, rate=rate, spm_rate=spm_rate)).collect()
    assert len(rows) == len(texts)
    want = Counter((i, *naive_infill(i, t, rate, spm_rate), t or "") for i, t in ((i if i % 50 else None, t) for i, t in enumerate(texts)))
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in rows) == want


def test_infill_on_odd_tables(spark):
    rows = infill.digests(odd.documents(spark)).collect()
    assert len(rows) == odd.documents(spark).count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.documents(spark).collect()}
    assert all(r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
    assert infill.digests(odd.empty(spark)).count() == 0


# -- factoring ----------------------------------------------------------------------------------

def naive_factoring(texts, span=35):
    """Texts -> (n_words, n_removed, kept) of each, by a table of all windows."""
    each = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + span]) for w in each for i in range(len(w) - span + 1))
    found = []
    for w in each:
        gone = set()
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i:i + span])] > 1:
                gone.update(range(i, i + span))
        found.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return found


def passages(seed):
    """Texts that share passages of all lengths, in all surroundings, next to each other and overlapping."""
    make = random.Random(seed)
    word = lambda: f"w{make.randrange(2000)}"
    shared = [[word() for _ in range(make.choice((34, 35, 36, 50, 70, 120)))] for _ in range(12)]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(make.randrange(1, 5)):
            words += [word() for _ in range(make.randrange(0, 60))]
            if make.random() < 0.6:
                own = make.choice(shared)
                start = make.randrange(0, 20)
                words += own[start:start + make.randrange(30, 130)]
        texts.append(" ".join(words))
    return texts + [texts[0], texts[1] + " more", "a " * 200, "b a " * 90, " ".join(["x", "y", "z"] * 20), "\t\n", "", None, texts[5].upper()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_factoring_removes_what_the_windows_say(spark, seed):
    texts = passages(seed)
    frame = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, t string, low int, mark long").repartition(5)
    rows = {r["doc_id"]: r for r in factoring.cleaned(frame).collect()}
    want = naive_factoring(texts)
    assert [(rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept"]) for i in range(len(texts))] == want
    for i, r in rows.items():
        words = (texts[i] or "").split()
        for f in r["factors"]:
            assert f["words"] >= factoring.SPAN
            if f["source"] is not None:
                assert words[f["start"]:f["start"] + f["words"]] == texts[f["source"]].split()[f["at"]:f["at"] + f["words"]]


def test_factoring_on_odd_tables(spark):
    docs = odd.documents(spark)
    texts = [r["text"] for r in docs.collect()]
    rows = factoring.cleaned(docs).collect()
    assert Counter((r["n_words"], r["n_removed"], r["kept"]) for r in rows) == Counter(naive_factoring(texts))
    twice = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40)))] * 3 + [(None, " ".join(f"b{i}" for i in range(40)))] * 2, "doc_id long, text string")
    assert {(r["n_words"], r["n_removed"], r["kept"]) for r in factoring.cleaned(twice).collect()} == {(40, 40, "")}
    assert factoring.cleaned(twice).count() == 5
    assert factoring.digests(odd.empty(spark)).count() == 0


def test_hot_passages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in factoring.cleaned(docs.withColumn("spans", F.lit(1))).collect()}
    assert rows == dict(zip([i for i, _ in texts], naive_factoring([t for _, t in texts])))
