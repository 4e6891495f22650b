"""The engine's entities over the driver's tables, and the same views as SQL for the DuckDB twins.

Derived columns follow fixed formulas of the ids, so both sides agree. Nothing here reads a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("topology", "current_state", "doctrine", "incident", "identity", "relationship", "decision", "idea", "session_log", "unknown")
SOURCES = ("user", "tool", "inferred", "brain", "migrated")
NOW = 1_735_689_600  # 2025-01-01T00:00:00Z
AGE = "((({id}) * 7919) % 34560000) / 86400.0D"


#: Bytes below which a table is not worth dealing out, above which its row groups are counted first, and of a piece of such a table.
SPREAD_BYTES, PIECE_BYTES = (4 << 20, 512 << 20), 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table that fewer tasks would read than there are cores, dealt evenly: all its rows may lie in one row group, which is one
    task's, however large it is. Columns and filters are still pushed to the scan. Other tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SPREAD_BYTES[0]:
        return df
    if size <= SPREAD_BYTES[1]:
        return df.repartition(cores) if len(df.inputFiles()) < cores else df
    # the parts of files that hold the middle of a row group; no column is read for it
    tasks = df.select(F.input_file_name(), F.input_file_block_start()).distinct().count()
    return df.repartition(max(cores, -(-size // PIECE_BYTES))) if tasks < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; timestamps without zone become instants in the session's zone (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = spread(df) if name in ("documents", "pages") else df
    casts = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream of its files, be it one file or a folder of them. A stream's path must be a folder or a
    pattern; this one matches the table only."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def pick(values: tuple[str, ...], index: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(index) % len(values) + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("memory_id"), F.col("source").alias("agent_id"), F.col("text").alias("summary"), "lang", "n_chars",
        F.when(F.expr("doc_id % 11 != 0"), pick(CATEGORIES, "doc_id")).alias("category"), F.when(F.expr("doc_id % 13 != 0"), pick(SOURCES, "doc_id div 10")).alias("source"),
        F.when(F.expr("doc_id % 19 != 0"), F.expr(AGE.format(id="doc_id"))).alias("age_days"), F.when(F.expr("doc_id % 17 = 0"), F.col("doc_id") + 1).alias("superseded_by"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("memory_id"), "embedding", F.when(F.expr("vec_id % 11 != 0"), pick(CATEGORIES, "label")).alias("category"),
        F.when(F.expr("vec_id % 19 != 0"), F.expr(AGE.format(id="vec_id"))).alias("age_days"),
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("memory_id"), "ts")


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("prompt"), F.col("props").alias("response"), "value")


def fact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assertions: a customer's priority, sure by status; every 29th order is a demotion."""
    confidence = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "high_probability").otherwise("false")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("entity"), F.lit("priority").alias("attribute"), F.col("o_orderkey").alias("seq"),
        F.when(F.expr("o_orderkey % 29 = 0"), "demote").otherwise("save").alias("kind"), F.col("o_orderpriority").alias("value"), confidence.alias("confidence"), F.col("o_orderdate").alias("ts"),
    )


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"

#: The same entities as common table expressions for DuckDB.
SQL = {
    "memories": f"""memories AS (SELECT doc_id AS memory_id, source AS agent_id, text AS summary, lang, n_chars,
        CASE WHEN doc_id % 11 <> 0 THEN ({_LIST(CATEGORIES)})[1 + doc_id % 10] END AS category,
        CASE WHEN doc_id % 13 <> 0 THEN ({_LIST(SOURCES)})[1 + (doc_id // 10) % 5] END AS source,
        CASE WHEN doc_id % 19 <> 0 THEN ((doc_id * 7919) % 34560000)::DOUBLE / 86400.0::DOUBLE END AS age_days,
        CASE WHEN doc_id % 17 = 0 THEN doc_id + 1 END AS superseded_by FROM documents)""",
    "vectors": f"""vectors AS (SELECT vec_id AS memory_id, embedding::DOUBLE[] AS embedding,
        CASE WHEN vec_id % 11 <> 0 THEN ({_LIST(CATEGORIES)})[1 + label % 10] END AS category,
        CASE WHEN vec_id % 19 <> 0 THEN ((vec_id * 7919) % 34560000)::DOUBLE / 86400.0::DOUBLE END AS age_days FROM embeddings),
        q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
        scored AS (SELECT v.*, list_distance(embedding, qv) AS distance, 1 / (1 + list_distance(embedding, qv)) AS similarity,
            list_cosine_similarity(embedding, qv) AS cosine FROM vectors v, q)""",
    "access": "access AS (SELECT user_id AS memory_id, count(*) AS access_count FROM events GROUP BY user_id)",
    "facts": """fact_events AS (SELECT o_custkey::VARCHAR AS entity, 'priority' AS attribute, o_orderkey AS seq,
        CASE WHEN o_orderkey % 29 = 0 THEN 'demote' ELSE 'save' END AS kind, o_orderpriority AS value,
        CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'high_probability' ELSE 'false' END AS confidence, o_orderdate AS ts FROM orders)""",
}
