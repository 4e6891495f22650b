"""Sinks of running streams: each micro-batch is written once, however often Spark replays it.

A query that dies between a write and its checkpoint gives the same batch number with the same rows again, so a batch is
either its own folder, which a replay overwrites, or an upsert by key, which a replay repeats without effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loomline.sources.commits import exists
from loomline.sources.files import upsert_memories

HEADS = "batch long, agent_id string, day string"


def _heads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEADS).parquet(path) if exists(spark, path) else spark.createDataFrame([], HEADS)


def write_trace_batch(rows: DataFrame, number: int, path: str, version: int = 1) -> None:
    """One micro-batch of tool calls (agent_id, ts, ...) as JSON lines under batch, agent and day.

    The first batch of an agent's day starts it with a header line. Which days have begun is kept beside the trace, in
    ``<path>-heads`` by batch; a replay looks at earlier batches only, so it writes what it wrote before. Rows without an
    agent or a time go under Spark's default folder, an empty batch writes nothing, and a caller's columns ``kind``,
    ``schema_version``, ``batch`` and ``day`` are not taken.
    """
    spark, heads_path = rows.sparkSession, f"{path.rstrip('/')}-heads"
    dated = rows.drop("kind", "schema_version", "batch", "day").withColumn("day", F.to_date("ts").cast("string"))
    groups = dated.groupBy("agent_id", "day").agg(F.min("ts").alias("ts"))
    begun = _heads(spark, heads_path).where(F.col("batch") < number).select(F.col("agent_id").alias("a"), F.col("day").alias("d"))
    fresh = groups.join(begun, F.col("agent_id").eqNullSafe(F.col("a")) & F.col("day").eqNullSafe(F.col("d")), "left_anti")
    lines = fresh.withColumn("kind", F.lit("header")).unionByName(dated, allowMissingColumns=True).withColumn("schema_version", F.lit(version))
    # by range, so that small groups share a task and a busy agent's day is split by time over several
    order = ["agent_id", "day", F.col("kind").isNull(), "ts"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").partitionBy("agent_id", "day").json(f"{path.rstrip('/')}/batch={number}")
    named = fresh.select(F.lit(number).cast("long").alias("batch"), "agent_id", "day")
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(heads_path)


def trace_sink(stream: DataFrame, path: str, checkpoint: str, version: int = 1, **trigger) -> StreamingQuery:
    """A started query that writes a trace while it runs."""
    write = lambda rows, number: write_trace_batch(rows, number, path, version)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "created_at", **trigger) -> StreamingQuery:
    """A started query that upserts memories (key, agent_id, order, ...) batch by batch: the last by ``order`` stays."""
    write = lambda rows, number: upsert_memories(rows.sparkSession, rows, path, key, order)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
