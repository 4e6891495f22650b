"""Session logs that grow: whole new lines of each file after its offset, and what of them may be consumed.

Offsets are a table (path, byte_offset) that the caller keeps, as a stream keeps its checkpoint. Files are read in the
tasks, a chunk at a time, from the offset on; a file that shrank is read from its start; a last line without its line feed
is left for the next round. Only line feeds end lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import nightly as N
from loomline.operators.sessions import pair_turns

LEAST_TURNS, IDLE_SECONDS, TURN_CAP, STRIDE_CAP = 6, 300, 3000, 2000
CHUNK = 1 << 20


def offsets_for(files: DataFrame, offsets: DataFrame, seeding: bool = False) -> DataFrame:
    """(path, size, idle_seconds, byte_offset) of the files there are: offsets of vanished files go, new files start at 0,
    or, when a folder is first taken up (``seeding``), at their present end; a file that shrank starts anew."""
    known = files.join(offsets.select("path", "byte_offset"), "path", "left")
    start = F.coalesce("byte_offset", F.col("size") if seeding else F.lit(0))
    return known.withColumn("byte_offset", F.when(F.col("size") < start, F.lit(0)).otherwise(start).cast("long"))


def new_lines(files: DataFrame) -> DataFrame:
    """(path, start, end, line) of every whole line after the offset (files with path and byte_offset); ``end`` is where the
    next line starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
                with store.open_input_file(name) as f:
                    f.seek(offset)
                    at, held = offset, b""
                    while chunk := f.read(CHUNK):
                        *whole, held = (held + chunk).split(b"\n")
                        rows = []
                        for line in whole:
                            rows.append((path, at, at + len(line) + 1, line.decode("utf-8", "replace")))
                            at += len(line) + 1
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["path", "start", "end", "line"])

    return files.select("path", F.col("byte_offset").cast("long")).mapInArrow(run, "path string, start long, end long, line string")


_PART = "array<struct<type:string,text:string,name:string,id:string,arguments:string>>"


def messages(lines: DataFrame, kinds: tuple[str, ...] = ("user", "assistant", "message")) -> DataFrame:
    """(path, start, end, role, content, thinking, actions, timestamp) of lines that hold a message of these kinds with text;
    others, and lines that are no JSON, give none."""
    rows = lines.withColumn("v", F.try_parse_json("line")).where("v is not null")
    rows = rows.withColumn("body", F.try_variant_get("v", "$.message.content", "variant"))
    rows = rows.withColumn("parts", F.when(F.schema_of_variant("body").startswith("ARRAY"), F.from_json(F.to_json("body"), _PART)))
    flat = N.flatten_message(F.transform("parts", lambda p: F.struct(F.when(p["type"] == "toolCall", F.lit("tool_use")).otherwise(p["type"]).alias("type"), p["text"].alias("text"), p["name"].alias("name"))))
    content = F.when(F.col("parts").isNotNull(), flat).otherwise(F.try_variant_get("body", "$", "string"))
    calls = F.filter(F.coalesce("parts", F.array().cast(_PART)), lambda p: p["type"].isin("tool_use", "toolCall"))
    thought = N.thinking_summary(F.coalesce("parts", F.array().cast(_PART)))
    role = F.try_variant_get("v", "$.message.role", "string")
    out = rows.where(F.try_variant_get("v", "$.type", "string").isin(list(kinds))).select(
        "path", "start", "end", role.alias("role"), F.coalesce(content, F.lit("")).alias("content"), F.nullif(thought, F.lit("")).alias("thinking"),
        F.transform(calls, lambda p: p["name"]).alias("actions"), F.try_variant_get("v", "$.timestamp", "string").alias("timestamp"),
    )
    return out.where(F.col("role").isNotNull() & (X.stripped(F.col("content")) != ""))


def sync_round(files: DataFrame, lines: DataFrame, found: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages to post, new offsets): a file posts all its new messages at once, if they are at least six or it has been
    idle for 300 seconds; else it waits, its offset unchanged. Lines without messages are consumed alone."""
    counts = found.groupBy("path").agg(F.count("*").alias("n"))
    ends = lines.groupBy("path").agg(F.max("end").alias("end"))
    state = files.join(counts, "path", "left").join(ends, "path", "left")
    n = F.coalesce("n", F.lit(0))
    waits = (n > 0) & (n < LEAST_TURNS) & (F.col("idle_seconds") < IDLE_SECONDS) & F.lit(not force)
    state = state.withColumn("waits", waits)
    offsets = state.select("path", F.when(F.col("waits"), F.col("byte_offset")).otherwise(F.coalesce("end", "byte_offset")).alias("byte_offset"))
    return found.join(state.where("not waits").select("path"), "path", "left_semi"), offsets


def watch_round(files: DataFrame, lines: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exchanges, new offsets): user turns with the answer that follows; a last user turn without one is held back, the
    offset before it. Texts are cut to 3000 characters; turns of less than two characters and without a call are passed."""
    turns = found.where((F.length(X.stripped(F.col("content"))) >= 2) | (F.size("actions") > 0))
    turns = turns.withColumn("text", F.substring(F.when(F.col("role") == "user", N.without_sender(F.col("content"))).otherwise(F.col("content")), 1, TURN_CAP))
    pairs = pair_turns(turns, "path", "start")
    last = turns.groupBy("path").agg(F.max_by(F.struct("role", "start"), "start").alias("m"))
    ends = lines.groupBy("path").agg(F.max("end").alias("end"))
    state = files.join(ends, "path", "left").join(last, "path", "left")
    held = F.coalesce(F.col("m.role") == "user", F.lit(False))
    return pairs, state.select("path", F.when(held, F.col("m.start")).otherwise(F.coalesce("end", "byte_offset")).alias("byte_offset"))


def commit_up_to(offsets: DataFrame, failed: DataFrame) -> DataFrame:
    """Offsets that stop at the first exchange (path, start) that could not be stored, so that it comes again."""
    first = failed.groupBy("path").agg(F.min("start").alias("stop"))
    return offsets.join(first, "path", "left").select("path", F.least("byte_offset", F.coalesce("stop", "byte_offset")).alias("byte_offset"))


def stride_pairs(batch: DataFrame, key: str = "session_id", order: str = "place", text: str = "text") -> DataFrame:
    """(key, n, prompt, response): every first and second of two messages of a closed session, each cut to 2000 characters;
    pairs without a prompt go, and so does a last message without a partner."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = batch.withColumn("k", at).groupBy(key, F.floor(F.col("k") / 2).cast("int").alias("n"))
    cut = lambda odd: F.substring(F.coalesce(F.max(F.when(F.col("k") % 2 == odd, F.col(text))), F.lit("")), 1, STRIDE_CAP)
    return rows.agg(cut(0).alias("prompt"), cut(1).alias("response"), F.count("*").alias("size")).where((F.col("size") == 2) & (X.stripped(F.col("prompt")) != "")).drop("size")


def seed_rows(spark, entries: list[dict]) -> DataFrame:
    """Facts as a file of seeds states them: entity, attribute, value and evidence are needed, other types become text."""
    needed = ("entity", "attribute", "value", "evidence_source")
    for k, entry in enumerate(entries):
        if missing := [c for c in needed if entry.get(c) in (None, "")]:
            raise ValueError(f"seed {k} lacks {', '.join(missing)}")
    return spark.createDataFrame([tuple(str(e[c]) for c in needed) for e in entries], ", ".join(f"{c} string" for c in needed))


def listing(files: DataFrame, agent: Column, day: Column) -> DataFrame:
    """(agent, day, files, bytes, mtime) of traces (path, size, mtime), newest first."""
    return files.groupBy(agent.alias("agent"), day.alias("day")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("mtime")).orderBy(F.col("mtime").desc(), "agent", "day")
