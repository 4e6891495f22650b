"""Streaming forms of the stateful exchange operators.

State is one small value per key (a time, a list of at most ``limit`` times, an open turn) and is dropped by event-time
timeout, so it stays bounded by the keys active within the window; states of many keys are held together (``keyed``). Watermarks
are set by the caller's stream.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.sources.commits import exists
from loomline.streaming.keyed import by_key


def _frames(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    parts = list(frames)
    return pd.concat(parts).sort_values(list(order), kind="stable") if parts else pd.DataFrame()


def drop_retries(stream: DataFrame, keys: list[str], ts: str, id_col: str, within: float = 900, late: str = "1 hour") -> DataFrame:
    """Exchanges that are not within ``within`` seconds of the last copy kept; a dropped copy extends nothing."""
    rows = stream.withWatermark(ts, late).withColumn("seconds", F.col(ts).cast("double"))
    fields = [rows.schema[k] for k in keys] + [rows.schema[id_col], T.StructField("seconds", T.DoubleType())]

    def keep(key: tuple, row: tuple, last: tuple | None) -> tuple[list[tuple], tuple]:
        i, seconds = row
        return ([], last) if last is not None and seconds - last[0] < within else ([(*key, i, seconds)], (seconds,))

    return by_key(rows.select(*keys, ts, id_col, "seconds"), keys, [ts, id_col], [id_col, "seconds"], keep, T.StructType(fields), "last double", lambda last: last[0] + within)


def accept_limited(stream: DataFrame, keys: list[str], ts: str, id_col: str, limit: int = 10, within: float = 3600, late: str = "1 hour") -> DataFrame:
    """(keys, id, accepted): at most ``limit`` accepted rows in any window of ``within`` seconds."""
    rows = stream.withWatermark(ts, late).withColumn("seconds", F.col(ts).cast("double"))
    fields = [rows.schema[k] for k in keys] + [rows.schema[id_col], T.StructField("accepted", T.BooleanType())]

    def accept(key: tuple, row: tuple, held: tuple | None) -> tuple[list[tuple], tuple | None]:
        i, seconds = row
        recent = [r for r in held[0] if seconds - r < within] if held else []
        ok = len(recent) < limit
        recent += [seconds] if ok else []
        return [(*key, i, ok)], (recent,) if recent else held

    return by_key(rows.select(*keys, ts, id_col, "seconds"), keys, [ts, id_col], [id_col, "seconds"], accept, T.StructType(fields), "recent array<double>", lambda held: held[0][-1] + within)


def pair_turns(stream: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, order, prompt, response): a user turn waits in state until the next turn shows whether it is answered."""
    fields = [stream.schema[key], stream.schema[order], T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType())]

    def pair(own: tuple, row: tuple, held: tuple | None) -> tuple[list[tuple], tuple]:
        turn, role, text = row
        told = [(*own, held[0], held[2], text)] if role == "assistant" and held is not None and held[1] else []
        return told, (turn, role == "user", text if role == "user" else None)

    return by_key(stream.select(key, order, "role", "text"), [key], [order], [order, "role", "text"], pair, T.StructType(fields), f"turn {stream.schema[order].dataType.simpleString()}, asked boolean, prompt string")


def session_counts(stream: DataFrame, key: str, ts: str, gap: str = "60 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions per key; a session is emitted once the watermark has passed its gap."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def live_log(spark, path: str) -> DataFrame:
    """Exchange log files as a stream, as they come: (timestamp, prompt, response, metadata); broken lines give none."""
    from loomline.sources.files import EXCHANGE

    lines = spark.readStream.option("lineSep", "\n").text(path)
    parsed = lines.select(F.from_json("value", EXCHANGE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return parsed.where("x is not null and x._bad is null").select("x.timestamp", "x.prompt", "x.response", "x.metadata")


def flushed(stream: DataFrame, key: str, ts: str, id_col: str, most: int = 6, idle: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(key, batch, ids): batches of ``most`` rows as soon as they are full, and what is left of a key once event time has
    passed its last row by ``idle``. State is one open batch a key."""
    rows = stream.withWatermark(ts, late).select(key, ts, id_col)
    pause = pd.Timedelta(idle).total_seconds()
    fields = [rows.schema[key], T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))]

    def flush(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, held, last = state.get if state.exists else (0, [], 0.0)
        held, out = list(held), []
        if state.hasTimedOut:
            if held:
                out.append((*k, batch, held))
            state.remove()
        else:
            pdf = _frames(frames, ts, id_col)
            for t, i in zip(pdf[ts], pdf[id_col], strict=True):
                if held and t.timestamp() - last >= pause:
                    out.append((*k, batch, held))
                    batch, held = batch + 1, []
                held.append(int(i))
                last = t.timestamp()
                if len(held) == most:
                    out.append((*k, batch, held))
                    batch, held = batch + 1, []
            state.update((batch, held, last))
            state.setTimeoutTimestamp(max(int((last + pause) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[f.name for f in fields])

    return rows.groupBy(key).applyInPandasWithState(flush, T.StructType(fields), "batch long, held array<long>, last double", "append", GroupStateTimeout.EventTimeTimeout)


def buffered(stream: DataFrame, key: str, order: list[str], entry: str, deliver: Callable[[tuple, list[str]], None] | None = None, most: int = 8, idle: float = 120, backlog: int = 200) -> DataFrame:
    """(key, n, entries, lost): a key's entries are delivered together once there are ``most``, or once ``idle`` seconds of
    the clock have passed without another one, whether or not anything else arrives.

    ``deliver`` hands a key's entries on, from the executors; where it raises, they wait for the key's next entry or the
    next timer, and of those that wait only the newest ``backlog`` are kept; ``lost`` says how many went since the last
    delivery. Deliveries that a lost executor or a restart repeats have the same entries, so they are at least once, while
    the returned rows follow the sink. Entries of one micro-batch are taken by ``order``; a null entry is none. State is one
    buffer a key and ends with its delivery. How many rows of a key meet is bounded by the source's rows a micro-batch.
    """
    if not 0 < most <= backlog or idle <= 0:
        raise ValueError("most is at least 1 and at most backlog, idle is positive")
    rows = stream.where(F.col(entry).isNotNull()).select(key, *order, F.col(entry).cast("string").alias("_entry"))
    fields = [rows.schema[key], T.StructField("n", T.IntegerType()), T.StructField("entries", T.ArrayType(T.StringType())), T.StructField("lost", T.LongType())]

    def flush(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, lost = state.get if state.exists else ([], 0)
        held, out = list(held), []

        def send() -> None:
            nonlocal held, lost
            try:
                if deliver is not None:
                    deliver(k, held)
            except Exception:
                lost += max(0, len(held) - backlog)
                held = held[-backlog:]
            else:
                out.append((*k, len(held), held, lost))
                held, lost = [], 0

        if state.hasTimedOut:
            send()
        else:
            for x in _frames(frames, *order)["_entry"]:
                held.append(x)
                if len(held) >= most:
                    send()
        if held:
            state.update((held, lost))
            state.setTimeoutDuration(int(idle * 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[f.name for f in fields])

    return rows.groupBy(key).applyInPandasWithState(flush, T.StructType(fields), "held array<string>, lost long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_until_still(stream: DataFrame, path: str, every: str = "200 milliseconds", longest: float = 3600) -> DataFrame:
    """Run a stream with clock timers until it has read what there is and holds no more state, then read its files back.

    Timers keep such a stream busy for ever, so availableNow would not end. Raises if it is not still after ``longest`` s.
    """
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime=every).start()
    until = time.monotonic() + longest
    try:
        while time.monotonic() < until:
            query.awaitTermination(0.2)  # raises what ended it
            done = query.recentProgress
            if len(done) > 1 and not done[-1].numInputRows and not sum(s.numRowsTotal for s in done[-1].stateOperators):
                break
        else:
            raise TimeoutError("the stream still reads or waits")
    finally:
        query.stop()
    spark, out = stream.sparkSession, f"{path}/out"
    return spark.read.schema(stream.schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], stream.schema)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there (availableNow) into files with a checkpoint beside them; read them back.

    Exactly-once by the file sink's log: a restart continues from the checkpoint.
    """
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
