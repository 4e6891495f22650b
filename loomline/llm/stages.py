"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame of the documents that go on.

All but the last return the columns of documents; further columns of the input, whatever their names, end here. Null
and empty texts go through every stage (they hold nothing and are like nothing); an empty table gives an empty table;
a missing label, benchmark item or id never stops a stage. What else a stage does in such cases is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below one half; the model learns from all labelled documents of the input.

    Every row is judged by its own text: rows with null or repeated ids too. Without labels of both kinds nothing goes
    unless all labels are 1.
    """
    bounded_batches(spark)
    from loomline.llm import toxicity as model

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    docs = docs.select(*DOCUMENTS)
    scored = model.score(docs, model.train(docs, labels), carry=True)
    return scored.where("score < 0.5").select(*[F.col(f"row.{c}") for c in DOCUMENTS])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more, the one with the smallest id.

    Rows without an id come after all others; ties of an id go to one text by its hash; of rows equal in id and text one
    stays. Texts without words are in no group and all stay.
    """
    bounded_batches(spark)
    from loomline.llm.jaccard_join import jaccard_components

    docs = docs.select(*DOCUMENTS).withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    found = jaccard_components(docs, size=5, percent=80).where("component is not null")
    named = F.col("id").eqNullSafe(F.col("component_id"))  # about one row a group, so no group gathers in a task
    first = found.where(named).groupBy(F.col("component").alias("group")).agg(F.min("text_hash").alias("first"))
    ties = found.where(named).join(first, F.col("component") == F.col("group")).where("text_hash != first")
    gone = found.where(~named).select("id", "text_hash").union(ties.select("id", "text_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash"))
    kept = docs.join(gone, same, "left_anti")
    repeated = found.groupBy("id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
    if not repeated.isEmpty():
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_hash"]))
    return kept.drop("_hash")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id holds.

    Texts that lose no word stay as they are; what is left of others is joined by single spaces. Documents that
    lose every word go. Rows without an id stay whole and take nothing from others; rows of one id take nothing from
    each other.
    """
    bounded_batches(spark)
    from loomline.llm.substring_dedup import substring_dedup as dedup

    cut = dedup(docs.select(*DOCUMENTS), carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.where("n_removed = 0 or n_removed < n_words").select(
        F.col("id").alias("doc_id"), text.alias("text"), "row.lang", "row.source",
        F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"),
    )


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; items without words or without an id count for nothing."""
    bounded_batches(spark)
    from loomline.llm.decontaminate import clean

    return clean(docs.select(*DOCUMENTS), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left; null and empty texts have none."""
    bounded_batches(spark)
    import public_tokenizers

    from loomline.llm.bpe import encode

    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "ids")
