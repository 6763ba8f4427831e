"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm import chat, factoring, infill, language, licenses, lines, mixing, neighbours, ngram_join, packing, pii, quality, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(_table(spark, folder, "documents"))


def op2_pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select(*mixing.RESULT)


def op3_hilbert_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents")).select(*packing.RESULT)


def op4_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(_table(spark, folder, "documents")).select(*quality.RESULT)


def op5_chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(_table(spark, folder, "conversations"))


def op6_similar_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.removed_lines(_table(spark, folder, "documents"), least=1)
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines"))


def op7_license_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents")).select(*licenses.RESULT)


def op8_count_vector_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.grouped(_table(spark, folder, "documents"))


def op9_word_backoff_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predicted(_table(spark, folder, "documents"))


def op10_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.grouped(_table(spark, folder, "embeddings"))


def op11_multiplicity_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_displacement_infill(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(_table(spark, folder, "documents"))


def op13_relative_factoring(spark: SparkSession, folder: str) -> DataFrame:
    return factoring.digests(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_boosted_pii, op2_pivotal_mix, op3_hilbert_packing, op4_line_quality, op5_chat_snapshots, op6_similar_lines, op7_license_diagonals, op8_count_vector_join,
             op9_word_backoff_language, op10_nn_descent, op11_multiplicity_whitening, op12_displacement_infill, op13_relative_factoring]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_quality": quality.SQL, "op5_chat_snapshots": chat.SQL,
            "op7_license_diagonals": licenses.sql(), "op8_count_vector_join": ngram_join.SQL,
            "op10_nn_descent": neighbours.SQL, "op12_displacement_infill": infill.SQL, "op13_relative_factoring": factoring.SQL}
