"""The corpus pipeline: quality rules, near duplicates, repeated passages, decontamination, packing.

Every stage is one of the operators of tessera.llm, works on all rows that the stage before it kept,
and is written as Parquet and read again. All stages but the last return the columns of `documents`;
where a stage cuts text, n_chars follows. SQL can't express the sequence (suffix structures, a
tokenizer), so ORACLE_SQL is None and tests hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, packing, quality, substrings
from tessera.llm._util import table, written
from tessera.llm.queries import vocabulary


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.judged(docs).filter("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id; of rows with one
    doc_id the first by text. Rows without a doc_id stay."""
    kept = jaccard.classes(docs).filter("doc_id = component_id").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("__tessera_n", first).filter("__tessera_n = 1").select(docs.columns)
    return named.union(docs.filter("doc_id is null").select(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that occur earlier; texts left empty go."""
    return _recounted(substrings.deduplicated(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark passages."""
    return _recounted(decontam.removed_passages(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir))
    return docs
