"""Language identification, word first.

A word the model knows is scored by its log frequency in each language. A word it does
not know backs off to character n-grams, four letters first and then ever shorter,
until enough of the word's n-grams are known. A text gets the language with the best
mean score; how sure that is follows from the means and from the number of words.

The model is counted by Spark over a bounded sample of labelled texts: about
``per_language`` documents of each language, chosen by hash, and the ``vocabulary`` most
frequent (word, language) pairs among them. So its size is bounded whatever the corpus.
Documents of the held-out quarter (crc32 of the id as text, modulo 4, is 2) are never
looked at. Predictions read the text alone.

Defined cases: a null text or one without letters is ``und`` with score 0, as is every
text if there is nothing to learn from; a document without an id or a label is predicted
but not learned from, and is not held out; ties go to the first language in order;
repeated rows each get their own result; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from opslens.llm.common import bounded_batches

UNKNOWN = "und"
#: Runs of word characters; numbers such as ``²`` or ``Ⅳ`` are among them and are taken out after.
RUNS = re.compile(r"[^\W\d_]+")
LONGEST = 4
SURE_WORDS = 20
ROWS = 300_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters (the categories L), as the training counts them."""
    found = RUNS.findall(text.lower()) if text else []
    if text and not text.isascii() and not all(map(str.isalpha, found)):
        found = [part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split()]
    return found


class Model:
    """Languages, and log frequencies of words and n-grams in each."""

    def __init__(self, languages: list[str], words: tuple[list[str], np.ndarray], grams: list[tuple[list[str], np.ndarray]]):
        self.languages = languages
        self.names, self.rows = words
        self.grams = grams


def counted(rows: list[tuple[str, str, int]], languages: list[str], smooth: float = 0.5) -> Model:
    """The model of (word, language, count) rows."""
    place = {language: i for i, language in enumerate(languages)}
    names: dict[str, int] = {}
    at = [names.setdefault(word, len(names)) for word, _, _ in rows]
    words = np.zeros((len(names), len(languages)))
    np.add.at(words, (at, [place[language] for _, language, _ in rows]), [n for _, _, n in rows])
    index: list[dict[str, int]] = [{} for _ in range(LONGEST)]
    met = [(array("i"), array("i")) for _ in range(LONGEST)]  # n-gram, word
    for i, word in enumerate(names):
        for n, gram in _pieces(word):
            met[n - 1][0].append(index[n - 1].setdefault(gram, len(index[n - 1])))
            met[n - 1][1].append(i)

    def logs(table: dict[str, int], counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not table:
            return [], np.zeros((0, len(languages)), dtype=np.float32)
        return list(table), np.log((counts + smooth) / (counts.sum(axis=0) + smooth * len(table))).astype(np.float32)

    grams = []
    for table, (gram, of) in zip(index, met):
        counts = np.zeros((len(table), len(languages)))
        np.add.at(counts, np.array(gram, dtype=np.int64), words[np.array(of, dtype=np.int64)])
        grams.append(logs(table, counts))
    return Model(languages, logs(names, words), grams)


def _pieces(word: str) -> list[tuple[int, str]]:
    padded = f"^{word}$"
    return [(n, padded[i:i + n]) for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1)]


class Scorer:
    """Scores texts; remembers the scores of unseen words up to a bound."""

    def __init__(self, languages: list[str], names: list[str], rows: np.ndarray, grams: list[tuple[list[str], np.ndarray]]):
        self.languages = languages
        self.n_known = len(names)
        self.known = {name: i for i, name in enumerate(names)}
        self.table = np.zeros((ROWS + self.n_known, len(languages)), dtype=np.float32)
        self.table[:self.n_known] = rows
        self.grams = [{name: own[i] for i, name in enumerate(of)} for of, own in grams]
        self.floor = np.full(len(languages), -12.0, dtype=np.float32)
        self.seen: dict[str, int] = {}

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest n-grams of which the model knows at least half."""
        padded = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            grams = [padded[i:i + n] for i in range(max(1, len(padded) - n + 1))]
            rows = [r for r in map(self.grams[n - 1].get, grams) if r is not None]
            if rows and 2 * len(rows) >= len(grams):
                return np.mean(rows, axis=0)
        return self.floor

    def _place(self, word: str) -> int:
        place = self.n_known + len(self.seen)
        self.table[place] = self.unseen(word)
        self.seen[word] = place
        return place

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        total, known, seen = np.zeros(len(self.languages)), self.known, self.seen
        for start in range(0, len(words), 10_000):
            some = words[start:start + 10_000]
            places = [known.get(w, -1) for w in some]
            for i, p in enumerate(places):
                if p < 0:
                    p = seen.get(some[i], -1)
                    if p < 0:
                        if len(seen) >= ROWS:  # places given before would change their meaning
                            return self._slow(words)
                        p = self._place(some[i])
                    places[i] = p
            total += self.table[places].sum(axis=0, dtype=np.float64)
        return self._sure(total / len(words), len(words))

    def _slow(self, words: list[str]) -> tuple[str, float]:
        self.seen.clear()
        total = np.zeros(len(self.languages))
        for word in words:
            p = self.known.get(word, -1)
            total += self.table[p] if p >= 0 else self.unseen(word)
        return self._sure(total / len(words), len(words))

    def _sure(self, mean: np.ndarray, n: int) -> tuple[str, float]:
        weight = np.exp((mean - mean.max()) * min(n, SURE_WORDS))
        best = int(mean.argmax())
        return self.languages[best], float(weight[best] / weight.sum())


def fitted(documents: DataFrame, per_language: int = 1500, vocabulary: int = 60_000, seed: int = 9) -> Model:
    """Counts the model; about ``per_language`` documents of each language are read.

    Each language gives the same number of words, its most frequent ones: ``vocabulary`` in
    all. A language with few documents does not lose its words to the others.
    """
    labelled = documents.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return counted([], [])
    parts = 1 << 24
    limits = F.create_map(*[F.lit(v) for lang in languages for v in (lang, int(min(1.0, per_language / sizes[lang]) * parts))])
    sample = labelled.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(parts)) < limits[F.col("lang")])
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    pairs = words.groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # over the words of a bounded sample
    top = pairs.withColumn("rank", rank).filter(F.col("rank") <= max(1, vocabulary // len(languages))).collect()
    return counted([(r["word"], r["lang"], r["n"]) for r in top], languages)


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with lang_pred and score added; other columns pass through."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(dict(vars(model or fitted(documents))))  # bounded by ``vocabulary``
    columns = [c for c in documents.columns if c not in ("lang_pred", "score")]
    kept = documents.select(*[F.col(f"`{c}`") for c in columns])
    text = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value  # a worker has one copy for all tasks, and one scorer with it
        if "scorer" not in parts:
            parts["scorer"] = Scorer(**parts)
        scorer = parts["scorer"]
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    types = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, types)


def predicted(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = model or fitted(documents)
    found = identify(documents.select("doc_id", "text"), model)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
