"""Lenses: passes of a model over session logs that leave notes, and the sweep that gives categories anew."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import scores
from loomline.functions import text as X
from loomline.operators import nightly as N
from loomline.operators.index import Embedder, embedded
from loomline.operators.pack import first_batch
from loomline.operators.vector import nearest_many

BATCH_CHARS, LOG_CHARS, NOTES, SAME = 24_000, 3000, 8, 0.90


#: Jobs of the maintenance loop, one round every 300 seconds: every how many rounds, and at which of them (fixed values).
MAINTENANCE = {"reclassify": (12, 0), "analyst": (12, 6), "muse": (24, 13)}


def due(tick: int) -> list[str]:
    """The jobs of a round of the maintenance loop, by its number from 1; a scheduler runs them as batch jobs."""
    return [name for name, (every, at) in MAINTENANCE.items() if tick > 0 and tick % every == at]


def candidates(logs: DataFrame, marks: DataFrame, lens: str, limit: int) -> DataFrame:
    """Oldest session logs that this lens has not marked; each lens reads every log once, whatever others did."""
    unread = logs.where("category = 'session_log'").join(marks.where(F.col("lens") == lens).select("memory_id"), "memory_id", "left_anti")
    return unread.orderBy(F.col("created_at").asc_nulls_first(), "memory_id").limit(limit)


def block(memory_id: Column, timestamp: Column, summary: Column, facts: Column, most: int = LOG_CHARS) -> Column:
    """A log as a lens reads it: cut to ``most`` characters, with at most six facts in 400."""
    own = F.coalesce(facts, F.array().cast("array<string>"))
    listed = F.substring(F.array_join(F.transform(F.slice(own, 1, 6), lambda f: F.concat(F.lit("- "), f)), "\n"), 1, 400)
    text = F.concat(F.substring(F.coalesce(summary, F.lit("")), 1, most), F.when(F.size(own) > 0, F.concat(F.lit("\n"), listed)).otherwise(F.lit("")))
    return F.concat(F.lit("[log "), memory_id.cast("string"), F.lit(" @ "), F.substring(F.coalesce(timestamp, F.lit("?")), 1, 16), F.lit("]\n"), text)


def note_id(lens: str, agent: str, summary: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{lens}:{agent}:"), summary), 256), 1, 16)


def unknown_notes(notes: DataFrame, index: DataFrame, same: float = SAME) -> DataFrame:
    """Notes (note_id, embedding, ...) whose nearest memory is less like them than ``same``; all, if nothing is indexed."""
    keyed = notes.withColumn("query", F.xxhash64("note_id"))
    near = nearest_many(index, keyed.select("query", "embedding"), 1, "memory_id", "query")
    pairs = near.join(keyed.select("query", F.col("embedding").alias("a")), "query").join(index.select(F.col("memory_id").alias("id"), F.col("embedding").alias("b")), "id")
    known = pairs.where(scores.cosine(F.col("a"), F.col("b")) >= same).select("query")
    return keyed.join(known, "query", "left_anti").drop("query")


def lens_pass(logs: DataFrame, marks: DataFrame, index: DataFrame, model: Callable[[str], str], embedder: Embedder, lens: str, agent: str, allowed: Sequence[str], limit: int = 60, budget: int = BATCH_CHARS, most: int = NOTES, today: str = "") -> tuple[DataFrame, DataFrame]:
    """(notes to save, marks to add) of one pass: the oldest unread logs that fit the budget go to the model as one text;
    its notes are checked, redacted, embedded, and left out if the index knows them. If the call or any embedding fails,
    nothing is marked, and the logs are read again; notes have ids of what they say, so that no note doubles.

    One batch and its notes are small by construction and pass through the driver.
    """
    blocks = candidates(logs, marks, lens, limit).withColumn("block", block(F.col("memory_id"), F.col("timestamp"), F.col("summary"), F.col("key_facts"))).withColumn("chars", F.length("block"))
    batch = first_batch(blocks, [F.col("created_at").asc_nulls_first(), F.col("memory_id")], "chars", budget).select("memory_id", "created_at", "block").orderBy(F.col("created_at").asc_nulls_first(), "memory_id").collect()
    spark, ids = logs.sparkSession, [r["memory_id"] for r in batch]
    kind = logs.schema["memory_id"].dataType.simpleString()
    none = spark.createDataFrame([], f"memory_id {kind}, lens string")
    empty = spark.createDataFrame([], f"note_id string, session_id string, agent_id string, summary string, key_facts array<string>, category string, derived_from array<{kind}>, embedding array<double>")
    if not batch:
        return empty, none
    try:
        reply = model("\n\n".join(r["block"] for r in batch))
    except Exception:
        return empty, none
    replies = spark.createDataFrame([(0, reply)], "id int, reply string").select("id", N.salvaged("reply").alias("objects"))
    notes = N.valid_notes(replies, tuple(allowed), most).select(X.redact(F.col("summary")).alias("summary"), F.transform("key_facts", X.redact).alias("key_facts"), "category")
    notes = notes.withColumn("note_id", note_id(lens, agent, F.col("summary"))).dropDuplicates(["note_id"])
    notes = notes.withColumn("text", F.concat_ws("\n", "summary", F.nullif(F.array_join("key_facts", "\n"), F.lit(""))))
    rows = notes.collect()
    if not rows:
        return empty, none.unionByName(spark.createDataFrame([(i, lens) for i in ids], none.schema))
    fixed = spark.createDataFrame(rows, notes.schema)
    done = fixed.drop("text").join(embedded(fixed, embedder, "note_id").drop("text"), "note_id")
    failed = not done.where("embedding is null").isEmpty()
    derived = F.array(*[F.lit(i) for i in ids]).cast(f"array<{kind}>")
    saved = unknown_notes(done.where("embedding is not null"), index).select("note_id", F.lit(f"{lens}-{agent}-{today}").alias("session_id"), F.lit(agent).alias("agent_id"), "summary", "key_facts", "category", derived.alias("derived_from"), "embedding")
    return saved, none if failed else spark.createDataFrame([(i, lens) for i in ids], none.schema)


def reclassified(memories: DataFrame, model: Column, include_routine: bool = True, limit: int | None = None) -> DataFrame:
    """(memory_id, category, classified_by, needs_reclassification) of memories whose category is unknown or missing, asked
    for again, or wrong for a routine log; the first ``limit`` by id. ``model`` is what a model says, or null."""
    empty = F.array().cast("array<string>")
    facts = F.coalesce("key_facts", empty)
    wanted = F.col("category").isNull() | (F.col("category") == "unknown") | F.coalesce("needs_reclassification", F.lit(False))
    if include_routine:
        wanted = wanted | ((F.coalesce("category", F.lit("")) != "session_log") & X.is_routine(F.col("summary"), facts))
    rows = memories.where(wanted)
    rows = rows if limit is None else rows.orderBy("memory_id").limit(limit)
    r = N.resolve_category(F.lit(None).cast("string"), F.coalesce("summary", F.lit("")), facts, model)
    return rows.select("memory_id", r.alias("r")).select("memory_id", "r.category", F.col("r.method").alias("classified_by"), "r.needs_reclassification")


def sweep_statistics(memories: DataFrame, done: DataFrame) -> DataFrame:
    """Counts by new category and method, beside how many were looked at and passed over."""
    by = done.groupBy("category", "classified_by").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(memories.agg(F.count("*").alias("scanned")))).crossJoin(F.broadcast(done.agg(F.count("*").alias("reclassified"))))
