import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.operators import nightly
from loomline.sources import commits, cursors, files
from loomline.streaming import exchanges, sinks

DAY = datetime(2026, 1, 2)


def lines(folder):
    return sorted(x for f in folder.rglob("*.json") for x in f.read_text().splitlines())


def test_trace_batches_have_one_header_a_day_and_may_be_replayed(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "agent_id string, ts timestamp, tool string, kind string")
    first = rows(("ann", DAY, "ls", "own"), ("ann", DAY + timedelta(hours=2), "cat", None), ("bob", DAY, "x", None))
    second = rows(("ann", DAY + timedelta(hours=3), "rm", None), ("ann", DAY + timedelta(days=1), "mv", None), (None, None, "lost", None))
    sinks.write_trace_batch(first, 0, path)
    sinks.write_trace_batch(second, 1, path)
    once = lines(tmp_path / "t")
    assert sum('"kind":"header"' in x for x in once) == 4 and len(once) == 10
    own = next(f for f in (tmp_path / "t/batch=0/agent_id=ann/day=2026-01-02").glob("*.json")).read_text().splitlines()
    assert [json.loads(x).get("kind") or json.loads(x)["tool"] for x in own] == ["header", "ls", "cat"]
    sinks.write_trace_batch(second, 1, path)
    sinks.write_trace_batch(first, 0, path)
    assert lines(tmp_path / "t") == once
    sinks.write_trace_batch(rows().where("false"), 2, path)
    assert lines(tmp_path / "t") == once


def test_streamed_upserts_keep_the_last_and_a_dead_writer_is_finished(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "m"), "id string, agent_id string, created_at double, summary string"
    stored = lambda: sorted(map(tuple, spark.read.schema(schema).parquet(path).select("id", "agent_id", "summary").collect()))
    batches = [[("a", "x", 1.0, "old"), ("b", "y", 1.0, "b1")], [("a", "x", 2.0, "new")], [("a", "x", 1.5, "late")]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        sinks.upsert_sink(stream, path, str(tmp_path / "c"), availableNow=True).awaitTermination()
        assert stored() == [("a", "x", "old" if k == 0 else "new"), ("b", "y", "b1")]
    with monkeypatch.context() as m:
        m.setattr(files, "_deal", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            files.upsert_memories(spark, spark.createDataFrame([("a", "x", 9.0, "newest")], schema), path)
    assert stored()[0][2] == "new"
    files.upsert_memories(spark, spark.createDataFrame([("c", "y", 1.0, "c1")], schema), path)
    assert stored() == [("a", "x", "newest"), ("b", "y", "b1"), ("c", "y", "c1")]


def test_audit_files_are_bounded_in_bytes(spark, tmp_path):
    rng = random.Random(5)
    want = [(k, "é" * rng.choice([0, 3, 40, 200])) for k in range(2000)]
    df = spark.createDataFrame(want, "ts long, note string")
    files.write_audit(df, str(tmp_path / "a"), 4000)
    parts = list((tmp_path / "a").rglob("*.txt"))
    assert max(p.stat().st_size for p in parts) <= 4000 and len(parts) < 2 * sum(p.stat().st_size for p in parts) / 3500
    read = [json.loads(x) for p in parts for x in p.read_text().splitlines()]
    assert sorted((r["ts"], r["note"]) for r in read) == want
    for p in parts:
        own = [json.loads(x)["ts"] for x in p.read_text().splitlines()]
        assert own == list(range(own[0], own[0] + len(own)))
    files.write_audit(df.limit(0), str(tmp_path / "none"), 4000)
    files.write_audit(df.limit(3), str(tmp_path / "long"), 1)  # every line is longer than a file: one each
    assert len(list((tmp_path / "long").rglob("*.txt"))) == 3


def test_a_dead_run_repeats_its_rows_and_an_empty_one_advances(spark, tmp_path):
    path = f"file://{tmp_path}/cursor"
    rows = spark.createDataFrame([(k, DAY + timedelta(hours=k)) for k in range(10)] + [(99, None)], "id long, modified timestamp")
    at = lambda h: DAY + timedelta(hours=h)
    ids = lambda window: sorted(r["id"] for r in window.of(rows).collect())
    with cursors.run(spark, path, at(3), DAY) as w:
        assert ids(w) == [0, 1, 2]
    with pytest.raises(OSError, match="dead"), cursors.run(spark, path, at(5), DAY) as w:
        assert ids(w) == [3, 4]
        raise OSError("dead")
    with cursors.run(spark, path, at(7), DAY) as w:
        assert ids(w) == [3, 4, 5, 6] and w.number == 2
    with cursors.run(spark, path, at(6), DAY) as w:  # the clock went back
        assert ids(w) == []
    assert cursors.last(spark, path) == (3, at(7))
    with cursors.run(spark, path, at(50), DAY) as w:
        assert ids(w) == [7, 8, 9]
    with cursors.run(spark, path, at(60), DAY) as w:
        assert ids(w) == []
    assert cursors.last(spark, path) == (5, at(60))
    with pytest.raises(commits.CommitConflict), cursors.run(spark, path, at(70), DAY), cursors.run(spark, path, at(71), DAY):
        pass
    assert cursors.last(spark, path) == (6, at(71))


def test_a_buffer_goes_when_full_or_by_the_clock(spark, tmp_path):
    folder, up, log = tmp_path / "in", tmp_path / "up", tmp_path / "log"
    folder.mkdir()

    def deliver(key, entries):
        if not up.exists():
            raise OSError("down")
        with open(log, "a") as f:
            f.write(f"{key[0]}:{','.join(entries)}\n")

    def arrive(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps({"k": k, "n": n, "e": e}) for k, n, e in rows))
        (tmp_path / name).rename(folder / name)

    def wait(condition):
        until = time.monotonic() + 40
        while not condition() and time.monotonic() < until:
            time.sleep(0.1)
        assert condition()

    stream = spark.readStream.schema("k string, n long, e string").json(str(folder))
    out = exchanges.buffered(stream, "k", ["n"], "e", deliver, most=3, idle=2, backlog=4)
    query = out.writeStream.format("memory").queryName("buffers").trigger(processingTime="100 milliseconds").start()
    got = lambda: sorted((r["k"], list(r["entries"]), r["lost"]) for r in spark.table("buffers").collect())
    try:
        up.touch()
        arrive("1", [("a", 2, "y"), ("a", 1, "x"), ("a", 3, "z"), ("a", 4, "w"), ("b", 1, "q"), ("b", 2, None)])
        wait(lambda: ("a", ["x", "y", "z"], 0) in got())  # full at once
        wait(lambda: len(got()) == 3)  # the others by the clock, nothing else came
        assert got() == [("a", ["w"], 0), ("a", ["x", "y", "z"], 0), ("b", ["q"], 0)]
        up.unlink()
        arrive("2", [("a", k, str(k)) for k in range(10, 17)])
        time.sleep(3)
        assert len(got()) == 3
        up.touch()
        wait(lambda: len(got()) == 4)
        assert ("a", ["13", "14", "15", "16"], 3) in got() and log.read_text().splitlines()[-1] == "a:13,14,15,16"
    finally:
        query.stop()
    with pytest.raises(ValueError, match="backlog"):
        exchanges.buffered(stream, "k", ["n"], "e", most=9, backlog=8)


def _named(section):
    if section == "bad":
        raise OSError("down")
    return f"b{section}"


def test_briefs_are_rolled_up_in_levels(spark, tmp_path):
    sizes = tmp_path / "sizes"
    sizes.mkdir()

    def joined(text):
        """First and last agent and the number of agents of a text of briefs, first-level or joined ones."""
        (sizes / f"{time.monotonic_ns()}-{len(text)}").touch()
        heads = [x[3:] for x in text.split("\n\n") if x.startswith("## ")]
        spans = [x.split() for x in text.split("\n\n") if not x.startswith(("#", "b"))]
        known = [(h, h, 1) for h in heads] + [(a, b, int(n)) for a, b, n in spans]
        assert [k[0] for k in known] == sorted(k[0] for k in known)
        return f"{known[0][0]} {known[-1][1]} {sum(k[2] for k in known)}"

    agents = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("agent_id"), F.when(F.expr("id % 1000 = 7"), "bad").otherwise(F.lit("x")).alias("section"))
    rows = nightly.briefs(agents, _named)
    assert rows.count() == 2997
    first = nightly.roll_up_level(rows, joined, "# T", 500)
    assert first.agg(F.sum("agents")).first()[0] == 2997 and first.count() < 150
    assert nightly.map_reduce_brief(agents, _named, joined, "# T", 500) == "00000 02999 2997"
    assert max(int(p.name.split("-")[1]) for p in sizes.iterdir()) <= 500
    torn = nightly.roll_up_level(rows, lambda t: joined(t) if "02999" not in t else _named("bad"), "# T", 500)
    assert 2950 < torn.agg(F.sum("agents")).first()[0] < 2997  # the failed group is missing, and is seen to be
    few = agents.where("agent_id < '00003'")
    assert nightly.map_reduce_brief(few, _named, lambda t: t, "# T") == "# T\n\n## 00000\n\nbx\n\n## 00001\n\nbx\n\n## 00002\n\nbx"
    with pytest.raises(RuntimeError, match="shorter"):
        nightly.map_reduce_brief(few, _named, lambda t: t * 3, "# T", 20)


def test_a_text_that_is_too_large_is_halved(spark):
    def small(text):
        if len(text) > 30:
            raise OverflowError(len(text))
        return text

    df = spark.createDataFrame([("a", "x" * 100 + "end"), ("b", None)], "k string, t string")
    got = nightly.asked(df, "t", small, too_large=lambda e: isinstance(e, OverflowError), least=10).orderBy("k").collect()
    assert got[0]["reply"] == "x" * 22 + "end" and got[1]["reply"] == ""
    assert nightly.asked(df, "t", small).orderBy("k").first()["reply"] is None


def test_stale_recipes(spark):
    recipes = spark.createDataFrame([(1, DAY), (2, DAY), (3, None), (4, DAY)], "id long, created timestamp")
    recalled = spark.createDataFrame([(2, DAY + timedelta(days=80)), (2, None), (4, DAY - timedelta(days=9)), (3, DAY)], "id long, ts timestamp")
    got = nightly.stale_recipes(recipes, recalled, F.lit(DAY + timedelta(days=100)).cast("timestamp"))
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4]
