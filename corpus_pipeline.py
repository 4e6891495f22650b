"""A training-data pipeline of the operators in loomline.llm: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import stages
from loomline.llm.common import remove_path, scratch_dir

STAGES = [
    ("toxicity", stages.toxicity),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("substring_dedup", stages.substring_dedup),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("bpe", stages.bpe),
]

#: SQL can express neither the trained toxicity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table goes as soon as the next one is written; the last stays in the shared folder for the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = scratch_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs
