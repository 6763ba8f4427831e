"""A corpus pipeline of five stages over ``documents``: from raw texts to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last give the columns of
their input.

* language: texts without letters, or without one clear language, go.
* lines: lines that are similar to an earlier line go, and texts that lose all lines;
  ``n_chars`` follows where the table has it.
* near_copies: of each group of linked texts the one with the smallest id stays.
* mix: every document appears as often as the mix of sources takes it.
* pack: pieces of sequences, as ``op3`` gives them.

Nulls, empty texts, repeated rows, empty tables and extra columns are as each operator
defines them; a null text has no language and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm import language, lines, mixing, ngram_join, packing
from opslens.session import new_folder

LEAST_SCORE = 0.5
#: Lines of one or two words (headings, answers, ends of verses) repeat without being copies, and their texts need them.
LEAST_WORDS = 3


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # scored beside a copy of the text, so that columns of any name pass through
    found = language.identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), language.fitted(docs))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = lines.cleaned(docs, least=LEAST_WORDS)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = ngram_join.copies(docs).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    # the row goes along in one column, so that columns of any name pass through
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), ngram_join.text_hash())
    left = own.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left_anti")
    named, nameless = left.filter("id is not null"), left.filter("id is null")
    return named.dropDuplicates(["id", "text_hash"]).unionByName(nameless).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", identified), ("lines", line_deduped), ("near_copies", copies_removed), ("mix", mixed), ("pack", packed)]

#: Not expressible in SQL: language scores, tokens and hash-driven rounding. The tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
