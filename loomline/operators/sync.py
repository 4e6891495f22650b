"""Live sessions: batches of messages as summaries, tool-call buffers, and what a reader of recall is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.nightly import tool_names
from loomline.operators.sessions import turn_budget

TURNS, SUMMARY_CAP, FACTS, RESPONSE_CAP = 20, 12_000, 10, 8000


def summaries(messages: DataFrame, agent: str, product: str = "Session", key: str = "batch_id") -> DataFrame:
    """(batch, session_id, messages, summary, key_facts) of batches of messages (batch, session_id, place, role, content).

    The last 20 turns, each cut by its budget, as long as 12,000 characters hold them; facts are the distinct tools that the
    assistant called, at most ten. Only what a summary shows is gathered.
    """
    newest = Window.partitionBy(key).orderBy(F.col("place").desc())
    rows = messages.withColumn("back", F.row_number().over(newest)).withColumn("all", F.count("*").over(Window.partitionBy(key)))
    budget = turn_budget(F.col("role"), F.col("content"))
    cut = F.concat(F.substr("content", F.lit(1), budget), F.when(F.length("content") > budget, F.lit("\u2026")).otherwise(F.lit("")))
    line = F.concat(F.lit("- ["), "role", F.lit("] "), cut)
    shown = rows.where(F.col("back") <= TURNS).groupBy(key, "session_id", "all").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    short = F.substring("session_id", 1, 8)
    head = F.array(F.concat(F.lit(f"{product} activity (auto-sync from JSONL, session="), short, F.lit(").")), F.concat(F.col("all").cast("string"), F.lit(" new message(s) since last sync.")), F.lit(""), F.lit("Turns:"))
    used = F.aggregate(head, F.lit(0), lambda n, p: n + F.length(p))
    start = F.struct(used.alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        full = s["full"] | (s["used"] + F.length(x) > SUMMARY_CAP)
        return F.struct(F.when(full, s["used"]).otherwise(s["used"] + F.length(x)).alias("used"), F.when(full, s["n"]).otherwise(s["n"] + 1).alias("n"), full.alias("full"))

    fold = F.aggregate("lines", start, step)
    rest = F.when(F.col("f.full"), F.array(F.concat(F.lit("... ("), (F.col("all") - F.col("f.n")).cast("string"), F.lit(" more turns truncated)")))).otherwise(F.array().cast("array<string>"))
    told = shown.withColumn("f", fold).withColumn("summary", F.substring(F.array_join(F.concat(head, F.slice("lines", F.lit(1), F.col("f.n")), rest), "\n"), 1, SUMMARY_CAP))
    used_tools = messages.where("role = 'assistant'").select(key, "place", F.posexplode(tool_names(F.col("content"))).alias("pos", "tool"))
    first = used_tools.groupBy(key, "tool").agg(F.min(F.struct("place", "pos")).alias("at"))
    few = first.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("r") <= FACTS)
    facts = few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tool"))), lambda x: F.concat(F.lit(f"{agent} invoked tool: "), x["tool"])).alias("key_facts"))
    none = F.array(F.concat(F.lit(f"{agent} session "), short, F.lit(" activity sync \u2014 no tool invocations in this batch")))
    return told.join(facts, key, "left").select(key, "session_id", F.col("all").alias("messages"), "summary", F.coalesce("key_facts", none).alias("key_facts"))


def captured(calls: DataFrame, policy: dict[str, str], key: str = "flush_id", marker: str = "auto_capture_flush") -> DataFrame:
    """(flush, calls, summary, key_facts) of buffered tool calls (flush, place, tool, summary) under a policy by tool: skip
    (also of unknown tools) leaves no trace, summary and drain a line, full a line and a fact of at most 100 characters."""
    rule = F.coalesce(F.create_map(*[x for k, v in policy.items() for x in (F.lit(k), F.lit(v))])[F.col("tool")], F.lit("skip"))
    rows = calls.withColumn("rule", rule).where("rule != 'skip'")
    line = F.concat(F.lit("- ["), "tool", F.lit("] "), "summary")
    every = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line"), "rule", F.substring("summary", 1, 100).alias("fact")))).alias("x"))
    facts = F.transform(F.filter("x", lambda r: r["rule"] == "full"), lambda r: r["fact"])
    text = F.concat(F.lit("[AUTO-CAPTURE] "), F.size("x").cast("string"), F.lit(" tool calls:\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"))
    return every.select(key, F.size("x").alias("calls"), text.alias("summary"), F.when(F.size(facts) > 0, facts).otherwise(F.array(F.lit(marker))).alias("key_facts"))


def shown_results(chunks: DataFrame, cap: int = RESPONSE_CAP, with_agent: bool = False) -> DataFrame:
    """(place, block) of recalled chunks (place, tier, relevance, content, category, source, age_days, severity, message,
    agent) as a reader sees them, while their lengths fit the cap, at least one; then a line that says how many more there
    are. A recall's chunks are few."""
    extra = F.concat_ws(" ", F.concat(F.lit("category="), "category"), F.concat(F.lit("source="), "source"), F.concat(F.lit("age="), F.floor(F.col("age_days") + 0.5).cast("string"), F.lit("d")))
    agent = F.concat(F.lit(" agent="), F.coalesce("agent", F.lit("?"))) if with_agent else F.lit("")
    head = F.concat(F.lit("["), F.coalesce("tier", F.lit("?")), F.lit("]"), agent, F.lit(" (relevance: "), F.format_string("%.2f", F.coalesce("relevance", F.lit(0.0))), F.lit(")"), F.when(extra != "", F.concat(F.lit(" "), extra)).otherwise(F.lit("")))
    warning = F.when(F.col("message").isNotNull(), F.concat(F.lit("\n\u26a0\ufe0f "), F.upper(F.coalesce("severity", F.lit("warn"))), F.lit(": "), "message")).otherwise(F.lit(""))
    rows = chunks.select("place", F.concat(F.lit("### "), head, warning, F.lit("\n"), "content").alias("block"))
    order = Window.orderBy("place")
    sized = rows.withColumn("used", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = sized.where((F.col("used") <= cap) | (F.col("k") == 1))
    ends = kept.agg(F.max("k").alias("shown"), F.max("n").alias("n"), F.max("place").alias("place")).where("n > shown")
    more = F.concat(F.lit("[Results capped \u2014 "), (F.col("n") - F.col("shown")).cast("string"), F.lit(" more memories matched. Narrow your query for more detail.]"))
    return kept.select("place", "block").unionByName(ends.select((F.col("place") + 1).alias("place"), more.alias("block")))
