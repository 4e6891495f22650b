"""Session logs as a stream whose offsets are byte positions, committed by Spark's checkpoint: format ``line_tail``.

Options: ``path``, a folder; ``suffix`` of its files (``.jsonl``); ``seed``, ``end`` to begin at the present ends of the files
that there are at the first start (``start``); ``slice_bytes``, how much of a file one task reads at most.

- Rows are (path, start, end, line): whole lines only, in UTF-8 (other bytes are replaced). A last line without its line feed
  waits: the end offset of a batch is the place after a file's last line feed.
- A file that is shorter than its offset begins anew at 0. A vanished file leaves the offsets; should it come back, it begins
  at 0, as new files do. A file that vanishes before its planned lines are read gives none.
- A batch is planned from its two offsets alone, so a restart after a loss neither loses nor doubles lines, as long as
  files only grow. Slices are cut at bytes; a line belongs to the slice in which it starts.
- An empty folder, empty files and empty lines are no errors; an empty line is a row.

The driver holds one entry a file, and looks at the sizes and at the torn end of each file only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start long, end long, line string"
CHUNK = 1 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _whole(path: str, size: int) -> int:
    """The place after the last line feed before ``size``; 0 if there is none."""
    store, name = _store(path)
    with store.open_input_file(name) as f:
        high = size
        while high > 0:
            low = max(0, high - CHUNK)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return 0


class Slice(InputPartition):
    """Lines of a file that start in [start, stop); ``first`` tells that a line starts at ``start``, ``end`` is the batch's end."""

    def __init__(self, path: str, start: int, stop: int, end: int, first: bool):
        self.path, self.start, self.stop, self.end, self.first = path, start, stop, end, first


def lines_of(part: Slice) -> Iterator[list[tuple[str, int, int, str]]]:
    store, name = _store(part.path)
    with store.open_input_file(name) as f:
        # Whether a line starts at the slice's first byte is told by the byte before it
        at = part.start if part.first else part.start - 1
        skipping = not part.first
        f.seek(at)
        held: list[bytes] = []
        read, begun = at, at
        while read < part.end and (read if skipping else begun) < part.stop:
            chunk = f.read(min(CHUNK, part.end - read))
            if not chunk:
                break
            read += len(chunk)
            *whole, rest = chunk.split(b"\n")
            rows = []
            for k, piece in enumerate(whole):
                line = b"".join((*held, piece)) if held else piece
                held = []
                after = begun + len(line) + 1
                if skipping:
                    skipping = False
                elif begun < part.stop:
                    rows.append((part.path, begun, after, line.decode("utf-8", "replace")))
                begun = after
            if rest:
                held.append(rest)
            if rows:
                yield rows


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".jsonl")
        self.seed, self.slice = options.get("seed", "start"), int(options.get("slice_bytes", 64 << 20))
        if self.seed not in ("start", "end") or self.slice < 1:
            raise ValueError("seed is start or end, slice_bytes at least 1")

    def _ends(self) -> dict[str, int]:
        store, name = _store(self.folder)
        prefix = self.folder.removesuffix(name)
        found = store.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
        sizes = {prefix + f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)}
        return {path: _whole(path, sizes[path]) for path in sorted(sizes)}

    def initialOffset(self) -> dict:
        return self._ends() if self.seed == "end" else {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, stop in sorted(end.items()):
            at = start.get(path, 0)
            at = 0 if stop < at else at
            out += [Slice(path, low, min(low + self.slice, stop), stop, low == at) for low in range(at, stop, self.slice)]
        return out or [Slice("", 0, 0, 0, True)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        try:
            for rows in lines_of(partition):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "start", "end", "line"])
        except FileNotFoundError:
            return

    def commit(self, end: dict) -> None:
        """Nothing to keep: the checkpoint holds the offsets."""


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tailed(spark: SparkSession, path: str, **options: str):
    """The lines of a folder's growing logs as a stream."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").options(path=path, **options).load()
