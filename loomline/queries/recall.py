"""Retrieval and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import adapters as A
from loomline.functions import scores
from loomline.operators import recall as R
from loomline.operators import vector as V
from loomline.operators.pivots import nearest_in_cells, write_cells
from loomline.sources.commits import scratch

_IMPORTANCE = "CASE category " + " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in scores.CATEGORY_IMPORTANCE.items()) + " ELSE 0.5::DOUBLE END"
_ACCESS = "least(1::DOUBLE, log2(1.0 + coalesce(access_count, 0)) / log2(7.0))"
_RECENCY = "CASE WHEN age_days IS NULL THEN 0.5::DOUBLE ELSE exp(-greatest(0, age_days) / 30.0 * ln(2.0)) END"
_SEVERITY = (
    "CASE WHEN category = 'topology' AND age_days >= 90 OR category IN ('current_state', 'session_log', 'unknown') AND age_days >= 135 OR category = 'relationship' AND age_days >= 270 THEN 'stale' "
    "WHEN category = 'topology' AND age_days >= 30 OR category IN ('current_state', 'session_log', 'unknown') AND age_days >= 90 OR category = 'relationship' AND age_days >= 180 THEN 'warn' END"
)


def knn(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest(A.vectors(spark, d), A.query_vector(spark, d), 10).select("memory_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = V.nearest_filtered(A.vectors(spark, d), A.query_vector(spark, d), 10, V.category_filter(exclude=["session_log", "idea"]))
    return found.select("memory_id", "category", F.round("distance", 6).alias("distance"))


def knn_included(spark: SparkSession, d: str) -> DataFrame:
    found = V.nearest_filtered(A.vectors(spark, d), A.query_vector(spark, d), 10, V.category_filter(include="doctrine"))
    return found.select("memory_id", "category", F.round("distance", 6).alias("distance"))


def knn_escalated(spark: SparkSession, d: str) -> DataFrame:
    found = V.nearest_escalated(A.vectors(spark, d), A.query_vector(spark, d), 8, V.category_filter(include="decision"))
    return found.select("memory_id", "category", F.round("distance", 6).alias("distance"))


def knn_many(spark: SparkSession, d: str) -> DataFrame:
    index = A.vectors(spark, d)
    queries = index.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "embedding")
    return V.nearest_many(index, queries, 5).select(F.col("query").alias("query_id"), F.col("id").alias("memory_id"), F.col("rank").cast("long").alias("place"), F.round("distance", 6).alias("distance"))


def knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same from a written index of cells, of which those too far from a query are not read."""
    path, index = scratch(spark, "cells"), A.vectors(spark, d)
    write_cells(index, path)
    queries = index.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "embedding")
    found, _ = nearest_in_cells(spark, path, queries, 5)
    return found.select(F.col("query").alias("query_id"), F.col("id").alias("memory_id"), F.col("rank").cast("long").alias("place"), F.round("distance", 6).alias("distance"))


def _tiers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The cached tiers and the vector tier over one scored index; positions follow each tier's order."""
    from pyspark.sql import Window

    scored = V.scored(A.vectors(spark, d), A.query_vector(spark, d))
    place = lambda df, *order: df.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    cached = scored.withColumn("age_seconds", F.expr("(memory_id * 613) % 172800"))
    by_cosine = (F.col("relevance").desc(), "memory_id")
    l1 = R.l1_hits(cached, 5, least=0.1).withColumn("relevance", F.col("cosine"))
    vec = V.nearest_filtered(A.vectors(spark, d), A.query_vector(spark, d), 10, V.category_filter(exclude=["session_log"])).withColumn("relevance", F.col("similarity"))
    l2 = R.l2_hits(scored, 5, above=0.1).withColumn("relevance", F.col("cosine"))
    l3 = R.l3_hits(scored.withColumn("created_at", -F.coalesce("age_days", F.lit(0.0))), R.metadata_predicate(exclude=["session_log"], max_age_days=300), 5, above=0.05).withColumn("relevance", F.col("cosine"))
    return {"l1": place(l1, *by_cosine), "vec": place(vec, "distance", "memory_id"), "l2": place(l2, *by_cosine), "l3": place(l3, *by_cosine)}


def l1_search(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d)["l1"].select("memory_id", F.round("relevance", 6).alias("relevance"), "position")


def l2_search(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d)["l2"].select("memory_id", F.round("relevance", 6).alias("relevance"), "position")


def l3_scan(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d)["l3"].select("memory_id", F.round("relevance", 6).alias("relevance"), "position")


def tier_union(spark: SparkSession, d: str) -> DataFrame:
    return R.union_tiers(_tiers(spark, d)).select("memory_id", F.round("relevance", 6).alias("relevance"), F.col("tier").cast("int").alias("tier"), "position")


def fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two query variants' pools fused by memory."""
    from functools import reduce

    from pyspark.sql import Window

    passes = []
    for k, vec_id in enumerate((0, 1, 2)):
        hits = V.nearest(A.vectors(spark, d), A.query_vector(spark, d, vec_id), 15)
        place = F.row_number().over(Window.orderBy("distance", "memory_id")).cast("int")
        passes.append(hits.select(F.col("memory_id").alias("key"), F.round("similarity", 6).alias("relevance"), F.lit(k).alias("pass_no"), place.alias("position")))
    fused = R.fuse(reduce(DataFrame.unionAll, passes))
    return fused.select("key", "relevance", F.col("seen_at.pass_no").alias("first_pass"), F.col("seen_at.position").alias("first_position"))


def _pool(spark: SparkSession, d: str, k: int, mode: str) -> DataFrame:
    from pyspark.sql import Window

    pool = V.nearest_filtered(A.vectors(spark, d), A.query_vector(spark, d), R.pool_size(k, mode), V.category_filter(exclude=R.hidden_categories(None, None)))
    pool = pool.withColumn("position", F.row_number().over(Window.orderBy("distance", "memory_id")).cast("long")).withColumn("relevance", F.col("similarity"))
    return R.with_access(pool.select("memory_id", "category", "age_days", "relevance", "position"), A.access_log(spark, d))


def recall_focus(spark: SparkSession, d: str) -> DataFrame:
    found = R.rank_focus(_pool(spark, d, 5, "focus"), 5)
    return found.select("memory_id", "category", "access_count", F.round("score", 6).alias("score"), scores.stale_severity(F.col("category"), F.col("age_days")).alias("severity"))


def recall_explore(spark: SparkSession, d: str) -> DataFrame:
    return R.rank_explore(_pool(spark, d, 5, "explore"), 5).select("memory_id", "category", "access_count", F.round("score", 6).alias("score"))


def expansion_gate(spark: SparkSession, d: str) -> DataFrame:
    hits = V.nearest(A.vectors(spark, d), A.query_vector(spark, d), 15).withColumn("relevance", F.col("similarity"))
    gate = R.should_expand(hits, "where does the gateway listen")
    gate2 = R.should_expand(hits.where("false"), "where does it listen")
    both = gate.withColumn("c", F.lit("found")).unionByName(gate2.withColumn("c", F.lit("nothing")))
    return both.select(F.col("c").alias("kind"), F.round("top", 6).alias("top"), F.round("mid", 6).alias("mid"), "n", "expand")


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    keep = R.metadata_predicate(source="tool", exclude=R.hidden_categories(None, None), max_age_days=200, exclude_stale=True)
    return A.memories(spark, d).where(keep).select("memory_id", "category", "source", F.round("age_days", 6).alias("age_days"))


def stale_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = A.memories(spark, d).withColumn("created", F.timestamp_seconds(F.lit(A.NOW) - F.col("age_days") * 86400))
    rows = rows.withColumn("w", scores.stale_warning(F.col("category"), F.col("age_days"), F.col("created"))).where("w is not null")
    return rows.select("memory_id", "w.category", F.col("w.threshold_days").alias("threshold_days"), F.col("w.severity").alias("severity"))


def disk_truth(spark: SparkSession, d: str) -> DataFrame:
    chunks = A.vectors(spark, d).select(F.when(F.expr("memory_id % 7 != 0"), F.col("memory_id") + F.expr("CASE WHEN memory_id % 23 = 0 THEN 100000000 ELSE 0 END")).alias("memory_id"), F.lit("idea").alias("category"), F.lit("brain").alias("source"), F.col("memory_id").alias("chunk_id"))
    found = R.disk_truth(chunks, A.memories(spark, d), F.expr("chunk_id % 14 = 0"))
    return found.select("chunk_id", "memory_id", "category", "source")


def access_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.access_log(spark, d).groupBy("memory_id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


def trajectory_recall(spark: SparkSession, d: str) -> DataFrame:
    """Rated recipes among over-fetched neighbours: similarity, rating and recency."""
    from loomline.plans.trajectories import recall

    index = A.vectors(spark, d).select("memory_id", "embedding", "age_days", F.expr("CAST(1 + memory_id % 5 AS INT)").alias("rating"), F.col("category").alias("task_type"))
    found = recall(index, A.query_vector(spark, d), k=5, task_type=None, min_rating=2)
    return found.select("memory_id", "rating", F.round("score", 6).alias("score"))


def capture_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = A.exchanges(spark, d)
    windows = rows.where("event_id % 997 = 0").select(F.col("ts").alias("start"), F.lit(120).alias("minutes"))
    return R.paused(rows, windows, F.col("prompt") == "view").select("event_id", "prompt")


def unprocessed(spark: SparkSession, d: str) -> DataFrame:
    """Oldest session logs that no lens has marked."""
    marked = A.table(spark, d, "labels").select(F.col("doc_id").alias("memory_id"))
    logs = A.memories(spark, d).where("category = 'session_log'")
    return logs.join(marked, "memory_id", "left_anti").orderBy(F.col("age_days").desc_nulls_last(), "memory_id").limit(40).select("memory_id", F.round("age_days", 6).alias("age_days"))


def index_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Rows on disk that the index lacks, index rows without a base row, and matches: one full outer join's counts."""
    m, v = A.memories(spark, d).select("memory_id", F.lit(1).alias("m")), A.vectors(spark, d).select((F.col("memory_id") * 3).alias("memory_id"), F.lit(1).alias("v"))
    kind = F.when(F.col("v").isNull(), "missing").when(F.col("m").isNull(), "orphan").otherwise("indexed")
    return m.join(v, "memory_id", "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Upsert: the last written row of each key."""
    rows = A.exchanges(spark, d)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "prompt"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.prompt")


def newest_per_agent(spark: SparkSession, d: str) -> DataFrame:
    rows = A.memories(spark, d).where("age_days is not null").withColumn("created_at", -F.col("age_days"))
    return R.newest(rows, 3, per=["agent_id"]).select("agent_id", "memory_id", F.round("age_days", 6).alias("age_days"))


def _with(*names: str, rest: str) -> str:
    return "WITH " + ", ".join(A.SQL[n] for n in names) + " " + rest


_VIS = "(category IS NULL OR category NOT IN ('session_log'))"
_TIERS_SQL = f"""
    , cached AS (SELECT *, cosine AS relevance FROM scored WHERE (memory_id * 613) % 172800 <= 86400 AND cosine >= 0.1 ORDER BY cosine DESC, memory_id LIMIT 5),
    l1 AS (SELECT memory_id, relevance, 1 AS tier, row_number() OVER (ORDER BY relevance DESC, memory_id) AS position FROM cached),
    vec AS (SELECT memory_id, similarity AS relevance, 2 AS tier, row_number() OVER (ORDER BY distance, memory_id) AS position
        FROM (SELECT * FROM (SELECT * FROM scored ORDER BY distance, memory_id LIMIT 50) WHERE {_VIS} ORDER BY distance, memory_id LIMIT 10)),
    l2 AS (SELECT memory_id, cosine AS relevance, 3 AS tier, row_number() OVER (ORDER BY cosine DESC, memory_id) AS position
        FROM (SELECT * FROM scored WHERE cosine > 0.1 ORDER BY cosine DESC, memory_id LIMIT 5)),
    l3 AS (SELECT memory_id, cosine AS relevance, 4 AS tier, row_number() OVER (ORDER BY cosine DESC, memory_id) AS position
        FROM (SELECT * FROM (SELECT * FROM scored WHERE {_VIS} AND (age_days IS NULL OR age_days <= 300) ORDER BY -coalesce(age_days, 0) DESC, memory_id LIMIT 80) WHERE cosine > 0.05 ORDER BY cosine DESC, memory_id LIMIT 5))"""
_POOL = f"""pool AS (SELECT s.*, row_number() OVER (ORDER BY distance, memory_id) AS position FROM
    (SELECT * FROM (SELECT * FROM scored ORDER BY distance, memory_id LIMIT {{wide}}) WHERE {_VIS} ORDER BY distance, memory_id LIMIT {{size}}) s),
    p AS (SELECT pool.*, coalesce(access_count, 0) AS access_count FROM pool LEFT JOIN access USING (memory_id))"""

QUERIES = {
    "knn": knn, "knn_filtered": knn_filtered, "knn_included": knn_included, "knn_escalated": knn_escalated, "knn_many": knn_many, "knn_cells": knn_cells,
    "l1_search": l1_search, "l2_search": l2_search, "l3_scan": l3_scan, "tier_union": tier_union, "fusion": fusion,
    "recall_focus": recall_focus, "recall_explore": recall_explore, "expansion_gate": expansion_gate, "metadata_filter": metadata_filter,
    "stale_warnings": stale_warnings, "disk_truth": disk_truth, "access_counts": access_counts, "trajectory_recall": trajectory_recall,
    "capture_gate": capture_gate, "unprocessed": unprocessed, "index_reconciliation": index_reconciliation, "latest_per_key": latest_per_key, "newest_per_agent": newest_per_agent,
}

ORACLE_SQL = {
    "knn": _with("vectors", rest="SELECT memory_id, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM scored ORDER BY scored.distance, memory_id LIMIT 10"),
    "knn_filtered": _with("vectors", rest="SELECT memory_id, category, round(distance, 6) AS distance FROM (SELECT * FROM scored ORDER BY distance, memory_id LIMIT 50) t WHERE category IS NULL OR category NOT IN ('session_log', 'idea') ORDER BY t.distance, memory_id LIMIT 10"),
    "knn_included": _with("vectors", rest="SELECT memory_id, category, round(distance, 6) AS distance FROM (SELECT * FROM scored ORDER BY distance, memory_id LIMIT 50) t WHERE category = 'doctrine' ORDER BY t.distance, memory_id LIMIT 10"),
    "knn_escalated": _with("vectors", rest=""", r AS (SELECT *, row_number() OVER (ORDER BY distance, memory_id) AS place FROM scored), f AS (SELECT * FROM r WHERE place <= 200 AND category = 'decision')
        SELECT memory_id, category, round(distance, 6) AS distance FROM f WHERE place <= 40 OR (SELECT count(*) FROM f WHERE place <= 40) < 8 ORDER BY f.distance, memory_id LIMIT 8"""),
    "knn_many": """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS memory_id, list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dist FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, memory_id) AS place FROM p) SELECT query_id, memory_id, place, round(dist, 6) AS distance FROM r WHERE place <= 5""",
    "l1_search": _with("vectors", rest=_TIERS_SQL + " SELECT memory_id, round(relevance, 6) AS relevance, position FROM l1"),
    "l2_search": _with("vectors", rest=_TIERS_SQL + " SELECT memory_id, round(relevance, 6) AS relevance, position FROM l2"),
    "l3_scan": _with("vectors", rest=_TIERS_SQL + " SELECT memory_id, round(relevance, 6) AS relevance, position FROM l3"),
    "tier_union": _with("vectors", rest=_TIERS_SQL + """, u AS (SELECT * FROM l1 UNION ALL SELECT * FROM vec UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
        SELECT memory_id, round(relevance, 6) AS relevance, tier::INTEGER AS tier, position FROM u QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY tier, position) = 1"""),
    "fusion": """WITH p AS (SELECT v.vec_id AS key, q.vec_id::INTEGER AS pass_no, 1 / (1 + list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS s, list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dist FROM embeddings v, embeddings q WHERE q.vec_id < 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY pass_no ORDER BY dist, key) AS position FROM p), h AS (SELECT key, round(s, 6) AS relevance, pass_no, position FROM r WHERE position <= 15)
        SELECT key, max(relevance) AS relevance, arg_min(pass_no, pass_no * 100 + position) AS first_pass, arg_min(position, pass_no * 100 + position)::INTEGER AS first_position FROM h GROUP BY key""",
    "recall_focus": _with("vectors", "access", rest="," + _POOL.format(wide=75, size=15) + f""", s AS (SELECT *, 0.55 * greatest(0, least(1, similarity)) + 0.20 * ({_RECENCY}) + 0.15 * ({_IMPORTANCE}) + 0.10 * ({_ACCESS}) AS sc FROM p)
        SELECT memory_id, category, access_count, round(sc, 6) AS score, {_SEVERITY} AS severity FROM s ORDER BY sc DESC, position LIMIT 5"""),
    "recall_explore": _with("vectors", "access", rest="," + _POOL.format(wide=125, size=25) + f""", t AS (SELECT *, max(similarity) OVER () AS best FROM p),
        s AS (SELECT *, CASE WHEN similarity < greatest(similarity, least(1, best)) - 0.08 THEN 0 ELSE 0.55 * greatest(0::DOUBLE, 1 - abs(similarity - (greatest(similarity, least(1, best)) - 0.03)) / 0.05) + 0.30 * ({_IMPORTANCE}) + 0.15 * (1 - ({_ACCESS})) END AS sc FROM t)
        SELECT memory_id, category, access_count, round(sc, 6) AS score FROM s WHERE sc > 0 ORDER BY sc DESC, position LIMIT 5"""),
    "expansion_gate": _with("vectors", rest=""", h AS (SELECT similarity FROM scored ORDER BY distance, memory_id LIMIT 15)
        SELECT 'found' AS kind, round(max(similarity), 6) AS top, round(median(similarity), 6) AS mid, count(*) AS n, max(similarity) - median(similarity) < 0.02 AS expand FROM h
        UNION ALL SELECT 'nothing', 0.0::DOUBLE, 0.0::DOUBLE, 0, true"""),
    "metadata_filter": _with("memories", rest=f"SELECT memory_id, category, source, round(age_days, 6) AS age_days FROM memories m WHERE source = 'tool' AND {_VIS} AND (m.age_days IS NULL OR m.age_days <= 200) AND coalesce({_SEVERITY.replace('age_days', 'm.age_days')}, '') <> 'stale'"),
    "stale_warnings": _with("memories", rest=f"SELECT memory_id, category, CASE category WHEN 'topology' THEN 30 WHEN 'relationship' THEN 180 ELSE 90 END AS threshold_days, {_SEVERITY} AS severity FROM memories WHERE {_SEVERITY} IS NOT NULL"),
    "disk_truth": _with("memories", rest=""", c AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 7 <> 0 THEN vec_id + CASE WHEN vec_id % 23 = 0 THEN 100000000 ELSE 0 END END AS memory_id FROM embeddings)
        SELECT chunk_id, c.memory_id, CASE WHEN c.memory_id IS NULL THEN CASE WHEN chunk_id % 14 = 0 THEN 'session_log' ELSE 'idea' END ELSE coalesce(m.category, 'idea') END AS category,
               CASE WHEN c.memory_id IS NULL THEN 'brain' ELSE coalesce(m.source, 'brain') END AS source
        FROM c LEFT JOIN memories m ON m.memory_id = c.memory_id WHERE c.memory_id IS NULL OR (m.memory_id IS NOT NULL AND m.superseded_by IS NULL)"""),
    "access_counts": "SELECT user_id AS memory_id, count(*) AS access_count, max(ts) AS last_accessed FROM events GROUP BY user_id",
    "trajectory_recall": _with("vectors", rest=""", h AS (SELECT *, 1 + memory_id % 5 AS rating FROM scored ORDER BY distance, memory_id LIMIT 30), r AS (SELECT * FROM h WHERE rating >= 2),
        n AS (SELECT *, CASE WHEN max(similarity) OVER () = min(similarity) OVER () THEN 1 ELSE (similarity - min(similarity) OVER ()) / (max(similarity) OVER () - min(similarity) OVER ()) END AS norm FROM r),
        s AS (SELECT *, 0.60 * norm + 0.25 * rating / 5 + 0.15 * CASE WHEN age_days IS NULL THEN 0 ELSE power(0.5, greatest(age_days, 0) / 30.0) END AS sc FROM n)
        SELECT memory_id, rating::INTEGER AS rating, round(sc, 6) AS score FROM s ORDER BY sc DESC, memory_id LIMIT 5"""),
    "capture_gate": "WITH w AS (SELECT ts AS start FROM events WHERE event_id % 997 = 0) SELECT event_id, event_type AS prompt FROM events e WHERE NOT (event_type = 'view' AND EXISTS (SELECT 1 FROM w WHERE e.ts >= w.start AND e.ts < w.start + INTERVAL 120 MINUTE))",
    "unprocessed": _with("memories", rest="SELECT memory_id, round(m.age_days, 6) AS age_days FROM memories m WHERE category = 'session_log' AND memory_id NOT IN (SELECT doc_id FROM labels) ORDER BY m.age_days DESC NULLS LAST, memory_id LIMIT 40"),
    "index_reconciliation": "SELECT CASE WHEN v.id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'orphan' ELSE 'indexed' END AS kind, count(*) AS n FROM documents d FULL JOIN (SELECT vec_id * 3 AS id FROM embeddings) v ON v.id = d.doc_id GROUP BY 1",
    "latest_per_key": "SELECT user_id, event_id, event_type AS prompt FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "newest_per_agent": _with("memories", rest="SELECT agent_id, memory_id, round(m.age_days, 6) AS age_days FROM memories m WHERE m.age_days IS NOT NULL QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY m.age_days, memory_id DESC) <= 3"),
}

ORACLE_SQL["knn_cells"] = ORACLE_SQL["knn_many"]
