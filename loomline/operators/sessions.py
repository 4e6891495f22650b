"""Exchange logs: retry dedup, sessions, turn pairing, tiers, roll-ups and recent context.

Rules whose state depends on earlier decisions are streamed folds over one key's narrow rows in arrival order: a lag or
a prefix sum would be wrong. Rows without order-dependent state stay windows or aggregates.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.text import lines
from loomline.operators.fold import Step, fields, streamed

GAP_SECONDS, MOST_ENTRIES, DEDUP_SECONDS = 3600, 500, 900
WARM_DAYS, COLD_DAYS = 3, 30
#: Characters kept of a turn: by role if it holds conversation, else those of a tool echo (fixed values).
TURN_BUDGET, ECHO_BUDGET = {"user": 2000, "assistant": 1200}, 300


def _timed(rows: DataFrame, keys: list[str], ts: str, id_col: str, *more: str) -> DataFrame:
    return rows.select(*keys, F.col(ts).cast("double").alias("seconds"), F.col(id_col), *more)


def drop_retries(rows: DataFrame, keys: list[str], ts: str, id_col: str, within: float = DEDUP_SECONDS) -> DataFrame:
    """Rows that are not repeats of the same exchange within the window of the last written copy: a dropped copy
    extends nothing."""
    n = len(keys)

    def start() -> Step:
        last: list[float] = []

        def step(row: tuple):
            if not last or row[n] - last[0] >= within:
                last[:] = [row[n]]
                yield (*row[:n], row[n + 1], row[n])

        return step

    narrow = _timed(rows, keys, ts, id_col)
    return streamed(narrow, keys, ["seconds", id_col], start, fields(narrow, [*keys, id_col, "seconds"]))


def accept_limited(rows: DataFrame, keys: list[str], ts: str, id_col: str, limit: int = 10, within: float = 3600) -> DataFrame:
    """Sliding rate limit: a row passes if fewer than ``limit`` accepted ones lie within the window before it."""
    n = len(keys)

    def start() -> Step:
        recent: deque[float] = deque()

        def step(row: tuple):
            while recent and row[n] - recent[0] >= within:
                recent.popleft()
            accepted = len(recent) < limit
            if accepted:
                recent.append(row[n])
            yield (*row[:n], row[n + 1], accepted)

        return step

    narrow = _timed(rows, keys, ts, id_col)
    return streamed(narrow, keys, ["seconds", id_col], start, fields(narrow, [*keys, id_col], accepted=T.BooleanType()))


def breaker_states(rows: DataFrame, key: str, ts: str, ok: str, id_col: str, threshold: int = 3, cooldown: float = 60) -> DataFrame:
    """Circuit breaker: after ``threshold`` failures in a row calls are skipped until the cooldown since the last failure
    has passed; then the count starts afresh."""

    def start() -> Step:
        state = {"fails": 0, "last": None}

        def step(row: tuple):
            own, t, i, good = row
            if state["fails"] >= threshold:
                if t - state["last"] < cooldown:
                    yield own, i, "skipped"
                    return
                state["fails"] = 0
            if good:
                state["fails"] = 0
            else:
                state.update(fails=state["fails"] + 1, last=t)
            yield own, i, "ok" if good else "failed"

        return step

    narrow = _timed(rows, [key], ts, id_col, ok)
    return streamed(narrow, [key], ["seconds", id_col], start, fields(narrow, [key, id_col], state=T.StringType()))


def sessions(rows: DataFrame, key: str, ts: str, id_col: str, gap: float = GAP_SECONDS, most: int = MOST_ENTRIES) -> DataFrame:
    """Session numbers per key: a new one after a gap of more than ``gap`` seconds or after ``most`` entries."""
    order = Window.partitionBy(key).orderBy(ts, id_col)
    apart = F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(order) > gap
    run = rows.withColumn("run", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order))
    inside = Window.partitionBy(key, "run").orderBy(ts, id_col)
    part = run.withColumn("part", F.floor((F.row_number().over(inside) - 1) / most).cast("int"))
    starts = F.lag(F.struct("run", "part")).over(order)
    changed = (starts.isNull() | (starts != F.struct("run", "part"))).cast("int")
    return part.withColumn("session_no", F.sum(changed).over(order).cast("int")).drop("run", "part")


def session_rollup(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("exchange_count"), F.min(ts).alias("first_exchange"), F.max(ts).alias("last_exchange"))


def session_tier(age_days: Column, entries: Column) -> Column:
    return F.when(entries == 0, F.lit("deleted")).when(age_days >= COLD_DAYS, F.lit("cold")).when(age_days >= WARM_DAYS, F.lit("warm")).otherwise(F.lit("hot"))


def tier_statistics(rows: DataFrame, size: str = "bytes") -> DataFrame:
    return rows.groupBy("tier").agg(F.count("*").alias("files"), F.round(F.sum(size) / (1 << 20), 2).alias("mb"))


def pair_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """User turns with the assistant turn that follows at once; a trailing user turn is held back."""
    at = Window.partitionBy(key).orderBy(order)
    nxt = turns.withColumns({"next_role": F.lead("role").over(at), "response": F.lead("text").over(at)})
    return nxt.where("role = 'user' and next_role = 'assistant'").select(key, order, F.col("text").alias("prompt"), "response")


def recent_context(rows: DataFrame, n: int, ts: str, id_col: str, cut: int = 300) -> DataFrame:
    """The newest n exchanges, chronologically, with short turns and times to the minute."""
    newest = rows.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)
    return newest.select(id_col, F.date_format(ts, "yyyy-MM-dd'T'HH:mm").alias("at"), F.substring("prompt", 1, cut).alias("prompt"), F.substring("response", 1, cut).alias("response")).orderBy("at", id_col)


def latest_tier(rows: DataFrame, key: str, tier: str, order: tuple[str, ...] = ("hot", "warm", "cold")) -> DataFrame:
    """The transcript of the first tier that has a session."""
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), F.col(tier))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where("r = 1").drop("r")


def turn_budget(role: Column, text: Column) -> Column:
    """Characters worth keeping of a turn: tool echoes are turns without any line of conversation."""
    talk = F.exists(lines(text), lambda x: x.rlike(r"^\s*(?!\[tool)\S"))
    by_role = F.coalesce(*[F.when(role == r, F.lit(n)) for r, n in TURN_BUDGET.items()], F.lit(ECHO_BUDGET))
    return F.when(talk, by_role).otherwise(F.lit(ECHO_BUDGET))


def budgeted_turn(role: Column, text: Column) -> Column:
    return F.substr(text, F.lit(1), turn_budget(role, text))


def hot_projection(rows: DataFrame) -> DataFrame:
    """What a keyword hit shows of an exchange: short texts, at most five actions, a short thought. ``rows`` has session_id,
    timestamp, prompt, response, actions (tool, command, output) and thinking."""
    shown = F.transform(F.slice(F.coalesce("actions", F.array()), 1, 5), lambda a: F.concat(F.lit("["), F.coalesce(a["tool"], F.lit("?")), F.lit("] "), F.coalesce(a["command"], F.lit("")), F.lit(" \u2192 "), F.coalesce(a["output"], F.lit(""))))
    return rows.select("session_id", "timestamp", F.substring("prompt", 1, 200).alias("prompt"), F.substring("response", 1, 200).alias("response"), shown.alias("actions"), F.substring("thinking", 1, 150).alias("thinking"))


def hot_listing(entries: DataFrame) -> DataFrame:
    """(session_id, entries, size_kb, modified) of hot sessions (file, is_exchange, bytes, modified), newest name first."""
    by = entries.groupBy(F.regexp_replace("file", r"\.jsonl$", "").alias("session_id"))
    return by.agg(F.sum(F.col("is_exchange").cast("long")).alias("entries"), F.round(F.sum("bytes") / 1024, 1).alias("size_kb"), F.max("modified").alias("modified")).orderBy(F.col("session_id").desc())


def warm_listing(rows: DataFrame) -> DataFrame:
    """(session_id, summary of at most 100 characters, number of facts), newest name first."""
    return rows.select("session_id", F.substring(F.coalesce("summary", F.lit("")), 1, 100).alias("summary"), F.greatest(F.size(F.coalesce("key_facts", F.array())), F.lit(0)).alias("key_facts")).orderBy(F.col("session_id").desc())


def dedup_seed(exchanges: DataFrame, now: float, window: float = DEDUP_SECONDS, newest: int = 512) -> DataFrame:
    """(hash, written) of the last ``newest`` lines of the newest file that lie within the window: what a dedup that
    starts anew must already know. Exchanges have file, modified, line, prompt, response and seconds."""
    last = exchanges.groupBy("file").agg(F.max("modified").alias("m")).orderBy(F.col("m").desc(), F.col("file").desc()).limit(1).select("file")
    tail = exchanges.join(F.broadcast(last), "file", "left_semi").orderBy(F.col("line").desc()).limit(newest)
    known = F.sha2(F.concat(F.col("prompt"), F.lit("\x00"), F.col("response")), 256)
    return tail.where(F.lit(now) - F.col("seconds") < window).groupBy(known.alias("hash")).agg(F.max("seconds").alias("written"))


def with_results(calls: DataFrame, results: DataFrame, key: str = "call_id", order: str = "place", most: int = 200) -> DataFrame:
    """Tool calls with status, exit code and the start of the output of their result (key, order, status, exit_code, output);
    of several the last counts, and a call without one stays, with nulls. A result's missing status or output is empty."""
    last = results.groupBy(key).agg(F.max_by(F.struct("status", "exit_code", "output"), order).alias("r"))
    found = calls.join(last, key, "left")
    known = lambda c: F.when(F.col("r").isNotNull(), F.coalesce(f"r.{c}", F.lit("")))
    return found.select(*calls.columns, known("status").alias("status"), F.col("r.exit_code").alias("exit_code"), F.substring(known("output"), 1, most).alias("output"))
