"""A training-corpus pipeline of five of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet in the shared folder and reads them again as the next stage's documents.  All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratavane import storage
from stratavane.llm import decontamination, exact, language, near, pieces


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay."""
    return language.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least id stays."""
    return near.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left, and whether they decode to its text."""
    out = pieces.encode(docs, pieces.load(), decoded="decoded")
    return out.selectExpr("doc_id", "CAST(size(ids) AS BIGINT) AS n_tokens", "ids", "decoded <=> coalesce(text, '') AS round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, path = docs, storage.new_path(spark, name)
        with storage.scratch(spark):  # what the stage's operator stages goes once its rows are written
            docs = storage.stage(stage(spark, docs, sf_dir), name, path)
        storage.release(before)
    return docs


#: MinHash classes and the language models can't be expressed in SQL; the tests hold the rows against
#: a brute-force version of every stage.
ORACLE_SQL = None
