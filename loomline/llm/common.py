"""Helpers shared by the operators: scratch tables, word hashes, document blocks.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which is what ``bytes.split()`` yields, so
texts stay UTF-8 bytes from Arrow to hash and are never decoded only to be split.
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: Odd multipliers of the public splitmix64 generator (fixed values).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

#: Distinct words one Python worker remembers before it starts afresh.
WORD_CACHE = 250_000


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that high bits are usable as a partition number."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Word bytes to a 64-bit hash; the memo is bounded and the hash equal on every worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter non-empty sequence is one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    last = len(words) - size + 1
    out = np.zeros(last, np.uint64)
    for k in range(size):
        out = mix64(out * GOLDEN + words[k : k + last] + np.uint64(k + size))
    return out


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder that the session names in spark.checkpoint.dir, or else the context.

    Without either, a local session gets a folder under the machine's temporary one, as there driver and executors
    are one process; on a cluster that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = checkpoint.get() if checkpoint.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/loomline-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and outlives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to now; called after a step that shuffled much."""
    gc.collect()  # frames of this process that still name them
    spark.range(1).count()  # Spark keeps the plan of the query that ran last
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing lazy reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            remove_path(df.sparkSession, path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark send its Python workers at most so many rows at a time. A setting of the session, so queries and stages
    make it and operators do not; they cut what they get all the same."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def tidy() -> None:
    """Give freed memory back to the system: a worker that is used again keeps it else, beside its next task's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Rows and bytes that an operator works on at a time; Spark bounds the batches they are cut from by bytes as well.
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20


def sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and, but for a single long row, bounded bytes."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and (part.num_rows > SLICE_ROWS or part.nbytes > SLICE_BYTES):
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part
    tidy()


def total_chars(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and characters of all texts."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("c")).first()
    return row["n"], row["c"] or 0


def hash_blocks(blocks: int) -> Column:
    """A block number by hash of the columns id and text, so that neither ids nor lengths nor nulls gather."""
    return F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")


#: Block bounds are one sorted list on the driver, so there are at most this many.
MAX_BLOCKS = 20_000


def block_bounds(docs: DataFrame, key: str, text: str, chars: int, block_chars: int) -> list[int]:
    """Ascending ids that open blocks 1, 2, ... of at most about twice ``block_chars``; every bound is an id of the table.

    Percentiles of the ids, each counted once for every mean length that its text has, so long texts lying together
    make more blocks and not larger ones. Beyond MAX_BLOCKS blocks they grow.
    """
    docs = docs.where(F.col(key).isNotNull())
    head = docs.agg(F.min(key).alias("lo"), F.count("*").alias("n")).first()
    blocks = max(1, min(-(-chars // block_chars), MAX_BLOCKS))
    if head["lo"] is None or blocks == 1:
        return []
    mean = max(1, chars // head["n"])
    weighed = docs.select(F.col(key), F.explode(F.sequence(F.lit(0), F.floor(F.coalesce(F.length(text), F.lit(0)) / mean).cast("int"))))
    row = weighed.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], 10 * max(1000, blocks)).alias("q")).first()
    return sorted({int(q) for q in row["q"] if q > head["lo"]})


def block_number(key: str, bounds: list[int]) -> Column:
    """How many bounds are at most the key, found in two levels of about sqrt(n) comparisons; null keys go to 0."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(r[0]).cast("long") for r in runs])
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in runs])
    value = F.col(key).cast("long")
    run = F.size(F.filter(heads, lambda h: h <= value))
    inner = F.size(F.filter(F.element_at(table, F.greatest(run, F.lit(1))), lambda h: h <= value))
    return F.when(value.isNull() | (run == 0), F.lit(0)).otherwise((run - 1) * step + inner).cast("int")


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as compressed planes of their differences."""
    import zstandard

    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    steps = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """int64 values as compressed planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def range_slices(ordered: np.ndarray, bits: int, width: int = 64) -> Iterable[tuple[int, slice]]:
    """Slices of ascending values that share their top ``bits`` of ``width``."""
    if bits == 0:
        yield 0, slice(0, len(ordered))
        return
    tops = ordered >> np.uint64(width - bits)
    cuts = np.flatnonzero(np.diff(tops)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(ordered)], strict=True):
        if b > a:
            yield int(tops[a]), slice(int(a), int(b))
