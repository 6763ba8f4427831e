"""The corpus pipeline against brute-force versions of its stages."""

from collections import Counter

import odd
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from opslens.llm import language, packing

SMALL = "/root/testdata/sf0.001"


def written(frame, path):
    frame.write.mode("overwrite").parquet(str(path))
    return frame.sparkSession.read.parquet(str(path))


def test_stages(spark, tmp_path):
    assert [name for name, _ in pipeline.STAGES] == ["language", "lines", "near_copies", "mix", "pack"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    frame = docs
    for name, stage in pipeline.STAGES:
        frame = written(stage(spark, frame, SMALL), tmp_path / name)
        kept[name] = frame
        if name != "pack":
            assert frame.dtypes == docs.dtypes, name
    rows = lambda name: [(r["doc_id"], r["text"]) for r in kept[name].orderBy("doc_id").collect()]
    first = rows("language")
    scores = {r["doc_id"]: r for r in language.predicted(docs).collect()}
    sure = [i for i, r in sorted(scores.items()) if r["lang_pred"] != "und" and r["score"] >= pipeline.LEAST_SCORE]
    assert [i for i, _ in first] == sure and len(sure) >= docs.count() - 2  # of the data nearly every document is in a known language
    gone = odd.removed(first)
    want = []
    for doc_id, text in first:
        left = [line for i, line in enumerate(text.split("\n")) if i not in gone[doc_id]]
        worded = [i for i, line in enumerate(text.split("\n")) if odd.words(line)]
        if not gone[doc_id] or len(gone[doc_id]) < len(worded):
            want.append((doc_id, "\n".join(left)))
    assert rows("lines") == want
    groups = odd.near_components(want)
    want = [(i, t) for i, t in want if groups[i] == i]
    assert rows("near_copies") == want
    mixed = Counter(i for i, _ in rows("mix"))
    assert set(mixed) <= {i for i, _ in want} and max(mixed.values()) <= 3
    size = lambda name: kept[name].agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(size("mix") - size("near_copies")) < 0.1 * size("near_copies")
    tokens = kept["pack"].agg(F.sum("length")).first()[0]
    own = packing.tokens(packing.tokenizer_path())
    assert tokens == sum(len(own.encode([t])[0]) // own.kind.itemsize + 1 for _, t in rows("mix"))


def test_run_takes_odd_and_empty_tables(spark, tmp_path):
    for name, make in (("odd", odd.documents), ("empty", odd.empty)):
        folder = tmp_path / name
        make(spark).write.parquet(f"{folder}/documents.parquet")
        result = pipeline.run(spark, str(folder))
        assert result.columns == packing.RESULT
        assert (result.count() > 0) == (name == "odd")


CLASHING = ["d", "h", "k", "removed", "n_removed", "n_lines", "h_own", "i_own", "copies", "rows", "own", "gone_id", "id", "text_hash", "_text_hash", "row", "copy", "n_words"]


def test_columns_of_any_name_pass_all_stages(spark, tmp_path):
    docs = odd.documents(spark)
    frame = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")) for c in CLASHING})
    for name, stage in pipeline.STAGES[:-1]:
        plain = written(stage(spark, docs, SMALL), tmp_path / f"plain-{name}")
        frame = written(stage(spark, frame, SMALL), tmp_path / f"clash-{name}")
        assert frame.columns == docs.columns + CLASHING, name
        count = lambda f: Counter((r["doc_id"], r["text"]) for r in f.collect())
        assert count(frame) == count(plain), name
        for c in CLASHING:
            assert frame.filter(F.col(c) != F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string"))).count() == 0, (name, c)
        docs = plain


def test_an_id_with_two_texts_keeps_the_one_that_is_no_copy(spark):
    words = lambda seed: " ".join(f"w{seed}x{i}" for i in range(40))
    a, b = words(1), words(2)
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b + " more"), (None, a)], "doc_id long, text string")
    left = Counter((r["doc_id"], r["text"]) for r in pipeline.copies_removed(spark, docs, "").collect())
    assert left == Counter({(1, a): 1, (2, b): 1, (None, a): 1})
