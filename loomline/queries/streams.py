"""Stateful operators run as streams over all events; each equals its batch form."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import adapters as A
from loomline.operators.nightly import map_reduce_brief
from loomline.queries import twins
from loomline.sources import cursors as C
from loomline.sources.commits import scratch
from loomline.sources.files import write_audit
from loomline.sources.tail import tailed
from loomline.streaming import exchanges as X
from loomline.streaming import sinks as K


def _events(spark: SparkSession, d: str) -> DataFrame:
    return A.stream(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("prompt"))


def stream_retry_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = X.drain(X.drop_retries(_events(spark, d), ["user_id", "prompt"], "ts", "event_id", within=86_400, late="40 days"), scratch(spark, "stream"))
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"), F.sum("event_id").alias("id_sum"))


def stream_rate_limited(spark: SparkSession, d: str) -> DataFrame:
    found = X.drain(X.accept_limited(_events(spark, d), ["user_id"], "ts", "event_id", limit=3, within=86_400, late="40 days"), scratch(spark, "stream"))
    return found.groupBy("user_id", "accepted").agg(F.count("*").alias("n"))


def stream_turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = X.drain(X.pair_turns(A.stream(spark, d, "conversations")), scratch(spark, "stream"))
    return pairs.select("conv_id", "turn", F.length("prompt").cast("long").alias("prompt_chars"), F.sha2("response", 256).alias("response_sha256"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text sizes of pages and the head that a file index would keep."""
    from loomline.sources.files import html_text

    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", html_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("chars"), F.contains("t", F.lit("track(")).alias("has_script"))


def stream_tailed_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns written as growing logs and tailed by byte offsets: rows and characters by role, and whether every line was whole."""
    logs = scratch(spark, "logs")
    spark.read.parquet(f"{d}/conversations.parquet").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value")).write.text(logs)
    lines = X.drain(tailed(spark, logs, suffix=".txt", slice_bytes=str(8 << 20)), scratch(spark, "stream"))
    rows = lines.select(F.from_json("line", "conv_id long, turn long, role string, text string").alias("m"), (F.col("end") - F.col("start") == F.octet_length("line") + 1).alias("whole"))
    return rows.groupBy("m.role").agg(F.count("*").alias("n"), F.sum("m.conv_id").alias("conv_sum"), F.sum(F.length("m.text")).alias("chars"), F.bool_and("whole").alias("whole"))


def _in_files(spark: SparkSession, rows: DataFrame, files: int = 4) -> DataFrame:
    """Rows as a stream of several micro-batches."""
    path = scratch(spark, "arrivals")
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_capture(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls of each user in deliveries of eight; what is left goes by the clock, with no further call."""
    calls = X.buffered(_events(spark, d), "user_id", ["ts", "event_id"], "event_id", idle=1)
    return X.run_until_still(calls, scratch(spark, "stream")).select("user_id", F.element_at("entries", 1).cast("long").alias("first_id"), "n", "lost", F.sha2(F.array_join("entries", ","), 256).alias("entries_sha256"))


def stream_traces(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls written as a trace while they arrive: lines, headers and ids by agent and day."""
    path = scratch(spark, "trace")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("agent_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    stream = _in_files(spark, rows)
    K.trace_sink(stream, path, scratch(spark, "checkpoint"), availableNow=True).awaitTermination()
    lines = spark.read.schema("agent_id string, day string, kind string, schema_version int, event_id long").json(path)
    return lines.groupBy("agent_id", "day").agg(F.count("event_id").alias("calls"), F.count("kind").alias("headers"), F.sum("event_id").alias("id_sum"))


def stream_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Memories upserted while they arrive: of every user the last event stays, in the folder of its tenant."""
    path = scratch(spark, "memories")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"), F.concat(F.lit("a"), F.expr("user_id % 7")).alias("agent_id"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("created_at"), F.col("event_type").alias("summary"))
    K.upsert_sink(_in_files(spark, rows), path, scratch(spark, "checkpoint"), availableNow=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).select("id", "agent_id", F.col("created_at.event_id").alias("event_id"), "summary")


def audit_files(spark: SparkSession, d: str) -> DataFrame:
    """An audit log in files of at most 64 kB: lines, bytes, and how many files are larger."""
    path = scratch(spark, "audit")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "user_id")
    write_audit(rows, path, 64_000, "event_id")
    lines = spark.read.text(path).select(F.octet_length("value").alias("b"), F.col("_metadata.file_path").alias("f"))
    files = lines.groupBy("f").agg(F.count("*").alias("n"), F.sum(F.col("b") + 1).alias("bytes"))
    return files.agg(F.sum("n").alias("lines"), F.sum("bytes").alias("bytes"), F.count(F.when(F.col("bytes") > 64_000, 1)).alias("too_large"))


def incremental_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs behind a durable cursor over the events of January: the second dies before its end, so the third gets its rows,
    the fourth finds nothing, and the last has the rest."""
    path = scratch(spark, "cursor")
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("modified"))
    found = []
    for k, (day, dies) in enumerate([((2024, 1, 8), False), ((2024, 1, 15), True), ((2024, 1, 20), False), ((2024, 1, 20), False), ((2024, 6, 1), False)]):
        try:
            with C.run(spark, path, datetime(*day), datetime(2000, 1, 1)) as window:
                rows = window.of(events).agg(F.lit(k).cast("long").alias("run"), F.lit(window.number).cast("long").alias("number"), F.count("*").alias("n"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("id_sum"))
                found.append(rows)
                if dies:
                    raise InterruptedError
        except InterruptedError:
            pass
    return reduce(DataFrame.unionByName, found)


def _chars(text: str) -> str:
    """Stands for a model: the number of characters of a section, or the sum of the numbers of joined briefs."""
    if text.startswith("# Briefs"):
        return str(sum(int(x) for x in re.findall(r"(?m)^\d+$", text)))
    return str(len(text))


def brief_tree(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's orders as a section, briefed and rolled up level by level while one input does not hold the briefs."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("string").alias("agent_id"), "o_orderkey")
    sections = orders.groupBy("agent_id").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), "\n").alias("section"))
    return spark.createDataFrame([(int(map_reduce_brief(sections, _chars, _chars, most=4000)),)], "chars long")


QUERIES = {
    f.__name__: f
    for f in (stream_retry_dedup, stream_rate_limited, stream_turn_pairs, stream_tailed_turns, stream_capture, stream_traces, stream_upserts, audit_files, incremental_runs, brief_tree, page_text)
}
_RUN = "SELECT {k}::BIGINT AS run, {n}::BIGINT AS number, count(*) AS n, coalesce(sum(event_id), 0)::BIGINT AS id_sum FROM events WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}'"
ORACLE_SQL = {
    "stream_retry_dedup": twins.ORACLE_SQL["retry_dedup"],
    "stream_rate_limited": twins.ORACLE_SQL["rate_limited"],
    "stream_turn_pairs": twins.ORACLE_SQL["turn_pairs"],
    "stream_tailed_turns": "SELECT role, count(*) AS n, sum(conv_id)::BIGINT AS conv_sum, sum(length(text))::BIGINT AS chars, true AS whole FROM conversations GROUP BY role",
    "stream_capture": """WITH r AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS part, ts FROM events)
        SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, count(*)::INTEGER AS n, 0::BIGINT AS lost, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id)) AS entries_sha256 FROM r GROUP BY user_id, part""",
    "stream_traces": "SELECT event_type AS agent_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, 1::BIGINT AS headers, sum(event_id)::BIGINT AS id_sum FROM events GROUP BY 1, 2",
    "stream_upserts": "SELECT user_id AS id, 'a' || (user_id % 7) AS agent_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS summary FROM events GROUP BY user_id",
    "audit_files": """SELECT count(*) AS lines, sum(octet_length(encode('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}')) + 1)::BIGINT AS bytes, 0::BIGINT AS too_large FROM events""",
    "incremental_runs": " UNION ALL ".join(
        _RUN.format(k=k, n=n, a=a, b=b)
        for k, n, a, b in ((0, 1, "2000-01-01", "2024-01-08"), (1, 2, "2024-01-08", "2024-01-15"), (2, 2, "2024-01-08", "2024-01-20"), (3, 3, "2024-01-20", "2024-01-20"), (4, 4, "2024-01-20", "2024-06-01"))
    ),
    "brief_tree": "SELECT sum(n)::BIGINT AS chars FROM (SELECT sum(length(o_orderkey::VARCHAR)) + count(*) - 1 AS n FROM orders GROUP BY o_custkey)",
    "page_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages),
        b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM a)
        SELECT page_id, length(t) AS chars, contains(t, 'track(') AS has_script FROM b""",
}
