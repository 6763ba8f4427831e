"""Operators that judge one row at a time: personal data, quality, licenses, language."""

import hashlib
import re

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from opslens.llm import language, licenses, pii, quality

NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module")
def model(spark):
    return pii.fitted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def naive(text):
    found = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(NAIVE[k], text) if pii.base_holds(k, m.group())]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def test_base_spans_are_those_of_the_plain_patterns():
    import random
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("a1@.-+ 2%(4)") for _ in range(r.randrange(1, 40)))
        assert pii.joined(pii.base_spans(text)[0]) == naive(text)


def test_pii_on_all_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.scan(docs, model).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = naive(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, row["spans"].split(",")))


def test_model_adds_written_out_forms_and_leaves_numbers_alone(model):
    for text in ("reach me at jane (at) example (dot) org today", "please call (456) 555-2186 now"):
        assert pii.redactions(text, model)[1], text
    for text in ("version 1.2.3 of 2024-01-31", "a total of 1 000 000 in section 3.2", "order 404189497460 of page 12"):
        assert pii.redactions(text, model) == ([], []), text
    assert pii.redacted("mail a@b.co!", [("email", 5, 11)]) == "mail [EMAIL]!"


def test_addresses_are_found_whole_with_or_without_a_written_dot(model):
    long = " dot ".join(f"part{i}" for i in range(30))  # far longer than what is read at first
    for address in ("jane (at) example.org", "jane[at]example.org", "jane(at)example.co.uk", "JANE AT EXAMPLE DOT ORG", "jane [AT] example (DOT) org",
                    f"{long} at example dot org", f"jane at {long} dot org", "jane (at) example dot org"):
        text = f"please write to {address}, today"
        assert ("email", 16, 16 + len(address)) in pii.candidates(text), address
    for address in ("jane (at) example.org", "jane[at]example.org", "JANE AT EXAMPLE DOT ORG", "jane [AT] example (DOT) org"):
        text = f"please write to {address}, today"
        assert pii.redactions(text, model)[1] == [("email", 16, 16 + len(address))], address
    for text in ("we met at home.Then we left", "look at the dot here", "a" * 300 + " at " + "b" * 300):
        assert pii.redactions(text, model) == ([], []), text


def test_prose_hosts_times_and_amounts_are_left_alone(model):
    for text in ("look at www.example.com", "meet at noon.Tomorrow", "see me at home.Then go", "file at data.csv is big", "we met at home.Then we left",
                 "2024-01-02 10:11:12.123", "logged 2023-11-05 23:59:59,999 by x", "values 1 000 000 000 000 000", "in 2019-2020 we sold 12 500 000 units",
                 "price 12,345,678.90 total", "look at page 12.3 now", "ratio 3.14159265358979", "isbn 978-12-3456"):
        assert pii.redactions(text, model) == ([], []), text
    for text in ("jane (at) example.org", "card 4111.1111.1111.1111 was", "call 555-123-4567 today"):
        assert pii.redactions(text, model)[1], text


def test_runs_of_address_parts_take_linear_time(model):
    for text in ("a at " * 50_000, "a.b@" * 50_000, "a dot " * 50_000 + "at b dot c", "x(at)" * 50_000, ("a." * 40 + "a at b.c ") * 2_000):
        pii.redactions(text, model)


def test_every_document_counts_in_the_fit(spark):
    rows = [(i, f"mail {'abc'[i % 3]}@example.org today") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.examples(docs).collect()
    assert sum(r["n"] for r in found) == 9000  # at most about 4,000 gave examples before
    assert all(r["label"] == 1 for r in found)


def test_sums_of_spark_and_of_the_driver_give_one_model(spark, monkeypatch):
    monkeypatch.setattr(pii.Boosted.__init__, "__defaults__", (3, 3, 0.3, 16, 1.0))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    here, there = pii.fitted(docs), pii.fitted(docs.repartition(3), local=0)
    assert here.thresholds == there.thresholds and len(here.trees.trees) == 3
    for one, other in zip(here.trees.trees, there.trees.trees, strict=True):
        assert all(np.allclose(a, b) for a, b in zip(one, other, strict=True))


def test_pii_on_odd_rows(spark, model):
    rows = pii.scan(odd.documents(spark), model, with_text=True).collect()
    assert len(rows) == odd.documents(spark).count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[14]["spans"] == "email:5:20" and "[EMAIL]" in by_id[14]["redacted_text"]
    assert by_id[4]["spans"] == "" and by_id[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.scan(odd.empty(spark)).count() == 0


def test_very_long_runs_take_linear_time(model):
    for text in ("a" * 500_000, "1" * 200_000, "a@" * 50_000, "1." * 100_000, "+" * 100_000):
        pii.redactions(text, model)


def test_quality_on_odd_rows(spark):
    rows = {r["doc_id"]: r for r in quality.judged(odd.documents(spark)).collect()}
    assert rows[1]["kept"] and rows[1]["n_words"] == 24 and rows[1]["cleaned_text"].count("\n") == 1
    assert rows[4]["base_failed"] and rows[4]["n_words"] == 0 and not rows[6]["kept"]
    assert rows[13]["n_repeat_words"] == rows[13]["n_words"] and not rows[13]["kept"]
    assert quality.judged(odd.empty(spark)).count() == 0


def test_failing_lines_go(spark):
    text = "This is a plain sentence that has rather more than ten words and a full stop in it.\nHome | About | Contact | Help\nAll rights reserved, click here.\nnav"
    row = quality.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["cleaned_text"] == text.split("\n")[0] and row["kept"]
    row = quality.judged(spark.createDataFrame([(1, text)], "doc_id long, text string"), max_lost=0.1).first()
    assert not row["kept"] and not row["base_failed"]


def test_licenses_on_odd_rows(spark):
    rows = {r["doc_id"]: r for r in licenses.scan(odd.documents(spark)).collect()}
    assert (rows[12]["n_base"], rows[12]["first_word"], rows[12]["last_word"], rows[12]["labels"]) == (2, 3, 8, "mit")
    assert [tuple(s) for s in rows[12]["spans"]] == [(0, 4, "mit"), (5, 9, "mit")]
    assert rows[4]["n_words"] == 0 and rows[4]["first_word"] is None and rows[4]["labels"] == "" and rows[4]["score"] == 0
    assert licenses.scan(odd.documents(spark)).count() == odd.documents(spark).count()
    assert licenses.scan(odd.empty(spark)).count() == 0


def test_license_votes_survive_a_lost_word(spark):
    text = "Some words. This program is free software: you can redistribute it and or change modify it under the terms of the GNU General Public License."
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "gpl" and len(row["spans"]) == 1 and row["spans"][0]["first"] == 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id")
    row = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.99 and 0 <= row[1] and row[2] <= 1


def test_language_on_odd_rows(spark):
    docs = odd.documents(spark)
    rows = language.predicted(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["lang_pred"] == by_id[5]["lang_pred"] == by_id[7]["lang_pred"] == "und" and by_id[7]["score"] == 0
    assert not by_id[None]["held_out"] and by_id[1]["lang_pred"] in ("en", "de")
    assert language.predicted(odd.empty(spark)).count() == 0
    passed = language.identify(docs)
    assert set(docs.columns) <= set(passed.columns) and passed.count() == docs.count()


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (3, "der hund und die katze", "de"), (4, "² ½ ①", None), (5, "Ⅳ", None), (6, "cat²the ٣", None)],
                                 "doc_id long, text string, lang string")
    model = language.counted([("the", "en", 5), ("cat", "en", 2), ("der", "de", 5)], ["de", "en"])
    found = {r["doc_id"]: r["lang_pred"] for r in language.predicted(docs, model).collect()}
    assert found[4] == found[5] == "und" and found[6] == found[1] == "en"
    assert language.words_of("cat²the Ⅳ é1") == ["cat", "the", "é"]


def test_a_small_language_keeps_its_words(spark):
    rows = [(i, f"word{'abcdefgh'[i % 8] * (1 + i % 5)} the of", "en") for i in range(400)] + [(1000 + i, "kissa istuu matolla", "fi") for i in range(3)]
    model = language.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocabulary=8)
    assert {"kissa", "istuu", "matolla"} & set(model.names)


def test_predictions_read_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fitted(docs)
    plain = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predicted(docs, model).collect()}
    bare = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z"))
    assert plain == {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predicted(bare, model).collect()}
    unknown = language.Scorer(**vars(model)).predict("thezzing andqqtion")
    assert unknown[0] in model.languages and 0 < unknown[1] <= 1
