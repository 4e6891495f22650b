"""Recall of rated recipes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.vector import nearest_filtered, with_sources

#: Weights of similarity, rating and recency, half life in days, candidates per result (fixed values).
W_SIMILARITY, W_RATING, W_RECENCY, HALF_LIFE, CANDIDATES = 0.60, 0.25, 0.15, 30.0, 6


def recall(index: DataFrame, vector: Sequence[float], k: int, task_type: str | None = None, min_rating: int = 1, now_age: str = "age_days", records: DataFrame | None = None) -> DataFrame:
    """Top k of max(6k, k) neighbours by min-max similarity, rating and recency; an unknown age counts as 0 recency.

    With ``records`` (memory_id, rating, age ...) the index holds vectors and types only; neighbours without a record go.
    """
    keep = F.lit(True) if task_type is None else F.coalesce(F.col("task_type") == task_type, F.lit(False))
    pool = nearest_filtered(index, vector, max(CANDIDATES * k, k), keep, factor=1 if task_type is None else 5)
    pool = (pool if records is None else with_sources(pool, records)).where(F.col("rating") >= min_rating)
    everything = Window.partitionBy(F.lit(1))
    lo, hi = F.min("similarity").over(everything), F.max("similarity").over(everything)
    near = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("similarity") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    fresh = F.when(F.col(now_age).isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), F.greatest(F.col(now_age), F.lit(0.0)) / HALF_LIFE))
    scored = pool.withColumn("lo", lo).withColumn("hi", hi).withColumn("score", W_SIMILARITY * near + W_RATING * F.col("rating") / 5 + W_RECENCY * fresh)
    return scored.drop("lo", "hi").orderBy(F.col("score").desc(), "memory_id").limit(k)
