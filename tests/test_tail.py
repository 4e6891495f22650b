"""The stream of growing logs: byte offsets, torn tails, shrunk files, restarts, slices."""

import json
import os

import pytest

from loomline.sources.tail import Slice, TailReader, lines_of, tailed


def _read(reader, start, end):
    return [row for part in reader.partitions(start, end) if part.path for rows in lines_of(part) for row in rows]


@pytest.mark.parametrize("slice_bytes", [1, 2, 3, 7, 1000])
def test_every_line_is_in_one_slice(tmp_path, slice_bytes):
    body = "one\n\nzwölf\n" + "x" * 50 + "\nlast\n"
    (tmp_path / "a.jsonl").write_text(body + "torn")
    reader = TailReader({"path": str(tmp_path), "slice_bytes": str(slice_bytes)})
    rows = _read(reader, {}, reader.latestOffset())
    assert [r[3] for r in sorted(rows, key=lambda r: r[1])] == body.split("\n")[:-1]
    raw = body.encode()
    assert all(raw[s : e - 1].decode() == line and raw[e - 1 : e] == b"\n" for _, s, e, line in rows)


def test_offsets_grow_shrink_and_leave(tmp_path):
    log = tmp_path / "a.jsonl"
    reader = TailReader({"path": str(tmp_path)})
    assert reader.latestOffset() == {} and _read(reader, {}, {}) == []
    log.write_bytes(b"a\nb")
    first = reader.latestOffset()
    assert list(first.values()) == [2]
    log.write_bytes(b"a\nbc\n\xff\n")
    second = reader.latestOffset()
    assert [r[1:] for r in _read(reader, first, second)] == [(2, 5, "bc"), (5, 7, "\ufffd")]
    log.write_bytes(b"z\n")
    third = reader.latestOffset()
    assert [r[3] for r in _read(reader, second, third)] == ["z"]
    assert TailReader({"path": str(tmp_path), "seed": "end"}).initialOffset() == third
    log.unlink()
    assert reader.latestOffset() == {}
    assert list(reader.read(Slice(str(log), 0, 2, 2, True))) == []


def test_bad_options(tmp_path):
    with pytest.raises(ValueError):
        TailReader({"path": str(tmp_path), "seed": "middle"})


def _run(spark, folder, out, **options):
    lines = tailed(spark, str(folder), **options)
    query = lines.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(once=True).start()
    query.awaitTermination()
    return sorted(r["line"] for r in spark.read.schema(lines.schema).parquet(f"{out}/rows").collect())


def test_restart_neither_loses_nor_doubles(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "a.jsonl").write_text("a1\na2\na3")
    (logs / "b.jsonl").write_text("")
    assert _run(spark, logs, out) == ["a1", "a2"]
    with open(logs / "a.jsonl", "a") as f:
        f.write(" whole\n")
    (logs / "b.jsonl").write_text("b1\n")
    assert _run(spark, logs, out) == ["a1", "a2", "a3 whole", "b1"]
    # a batch that was planned and not committed comes again as it was planned
    commits = sorted((out / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    os.remove(commits[-1])
    crc = commits[-1].with_name(f".{commits[-1].name}.crc")
    if crc.exists():
        os.remove(crc)
    with open(logs / "b.jsonl", "a") as f:
        f.write(json.dumps({"n": 2}) + "\n")
    _run(spark, logs, out)
    assert _run(spark, logs, out) == ["a1", "a2", "a3 whole", "b1", '{"n": 2}']
