"""Target-distribution importance resampling: draw the documents that read most like a target, with Gumbel noise.

Features are all runs of one to three words (lower-cased A-Z; a word is a run of digits, a-z and non-ASCII characters),
hashed into ``BUCKETS`` buckets by CRC-32. A bucket's gain is the logarithm of its smoothed share in the target over that
in the corpus, in thousandths, rounded down; a document's weight is the sum of its features' gains. The score adds
Gumbel noise that the id alone decides, so the highest scores are a sample without replacement in proportion to the
weights' exponentials, and the same sample wherever and however often it is taken.

Method. One pass counts the buckets of corpus and target: tasks add up arrays and send a row for every bucket that they
met, Spark adds the rows. The gains, one array of ``BUCKETS`` numbers, go to all tasks, and a second pass scores each
text by indexing that array with the buckets of its features. CRC-32 is linear, so a run's code is put together from its words' codes by
table look-ups on whole arrays, without making the run's text. The k-th best key (score descending, id ascending) is
found by radix selection: each round counts the rows that agree with the digits found so far by their next ``DIGIT`` bits
and picks the digit in which the k-th lies; only counts of digits come to the driver. Rows up to that key, a few hundredths of the
table, are counted by key, dealt out by range, and ranked from counts a block. Others are never sorted or shuffled.

Defined cases: null and empty texts have no features, weigh 0 and are not drawn; a null id has the noise of an empty
id and comes after all ids among equal scores; rows with equal scores and ids are ordered by their features; equal
rows get ranks one after another; an empty table gives no rows, and an empty target makes its share uniform; texts of
any length are scored whole; other columns are not returned, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate, batched
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import materialize, sized, texts_of

BUCKETS, RUN, LEAST_WORDS = 10_000, 3, 20
SEED = 42
#: Bits of the key that one round of the selection decides.
DIGIT = 12
#: Ranked rows of one block; distinct words a worker remembers; words of a text that are taken at a time.
BLOCK_ROWS, WORD_CACHE, CHUNK = 200_000, 250_000, 200_000

#: Bytes to lower case, all but digits, letters and bytes of non-ASCII characters to spaces.
WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_CRC = np.array([crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)], np.uint32)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _shift(length: int) -> np.ndarray:
    """4 x 256 table: what a CRC's byte becomes by ``length`` bytes more, so that crc(a + b) = shift(crc(a)) ^ crc(b)."""
    state = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(length):
        state = (state >> np.uint32(8)) ^ _CRC[state & np.uint32(255)]
    return state


#: Lengths up to which the tables are made in advance.
LONG = 64


@lru_cache(4096)
def _long_shift(length: int) -> np.ndarray:
    """``_shift`` of any length by powers of two: applying a table to each entry of another joins the two."""
    table, power = _shift(0), _shift(1)
    while length:
        if length & 1:
            table = _apply(power, table)
        power, length = _apply(power, power), length >> 1
    return table


def _apply(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return table[0, codes & 255] ^ table[1, codes >> 8 & 255] ^ table[2, codes >> 16 & 255] ^ table[3, codes >> 24]


class Words(dict):
    """Words to the CRCs of the word (lower half) and of a space and the word (upper half); the memo is bounded."""

    tables = np.stack([_shift(n) for n in range(LONG + 1)])

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = crc32(word) | crc32(b" " + word) << 32
        return value

    def _append(self, codes: np.ndarray, spaced: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Codes of runs that get a space and a word more each, ``added`` bytes in all."""
        short = np.minimum(added, LONG)
        out = spaced.copy()
        for k in range(4):
            out ^= self.tables[short, k, (codes >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(added > LONG):  # rare
            out[i] = spaced[i] ^ _apply(_long_shift(int(added[i])), codes[i : i + 1])[0]
        return out

    def codes(self, words: list[bytes], run: int) -> Iterator[np.ndarray]:
        """CRC-32 of all runs of one to ``run`` words, shortest first."""
        both = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        added = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes, spaced = both.astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)
        for size in range(1, min(run, len(words)) + 1):
            if size > 1:
                codes = self._append(codes[:-1], spaced[size - 1 :], added[size - 1 :])
            yield codes


def bucket_runs(words: Words, tokens: list[bytes], buckets: int, run: int) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, in arrays of bounded length: pieces overlap by a run less one word."""
    for start in range(0, len(tokens), CHUNK):
        piece = tokens[start : start + CHUNK + run - 1]
        for size, codes in enumerate(words.codes(piece, run), 1):
            yield codes[: min(CHUNK, len(tokens) - start - size + 1)] % np.uint32(buckets)


def _counted(buckets: int, run: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(buckets, np.int64)
        for batch in sized(batches):
            for texts in batched(texts_of(batch.column(0)), 50):
                found = [f for text in texts for f in bucket_runs(words, words_of(text), buckets, run)]
                total += np.bincount(np.concatenate(found) if found else np.zeros(0, np.int64), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int32()), "n": pa.array(total[met], pa.int64())})

    return count


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into a bucket."""
    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_counted(buckets, run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket in thousandths, rounded down, from two tables of ``bucket_counts``."""
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (corpus, target))  # at most a row a bucket
    all_s, all_t = sum(s.values()), sum(t.values())
    return [math.floor(1000 * math.log(float(t.get(b, 0) + 1) * float(all_s + buckets) / (float(s.get(b, 0) + 1) * float(all_t + buckets)))) for b in range(buckets)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, rounded down."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(gain, run: int, seed: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(), np.array(gain.value, np.int64)
        for batch in sized(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                tokens = words_of(text)
                features = weight = 0
                for found in bucket_runs(words, tokens, len(table), run):
                    features += len(found)
                    weight += int(table[found].sum())
                out.append((len(tokens), features, weight, weight + noise(doc_id, seed)))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), **{c: pa.array(v, pa.int64()) for c, v in zip(("n_words", "n_features", "weight", "score"), columns, strict=True)}})

    return weigh


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """Per row: id, n_words, n_features, weight, score."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_weighed(docs.sparkSession.sparkContext.broadcast(gain), run, seed), "id long, n_words long, n_features long, weight long, score long")


def _digit(value: Column, shift: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND((1 << DIGIT) - 1)


def kth_key(rows: DataFrame, parts: list[str], k: int) -> tuple[int, ...] | None:
    """The k-th smallest of the keys that the non-negative long columns ``parts`` make, by radix selection.

    Every round is one aggregate over the rows; at most 2^DIGIT counts of it come to the driver. None if there are fewer.
    """
    tops = rows.agg(*[F.max(c).alias(c) for c in parts], F.count("*").alias("rows")).first()
    if not 0 < k <= tops["rows"]:
        return None
    key: tuple[int, ...] = ()
    for part in parts:
        shift = max(0, -(-max(1, tops[part].bit_length()) // DIGIT) - 1) * DIGIT
        prefix = 0
        while shift >= 0:
            agree = rows.where(F.shiftright(part, min(shift + DIGIT, 63)) == prefix) if shift + DIGIT < 63 else rows
            for c, value in zip(parts, key, strict=False):
                agree = agree.where(F.col(c) == value)
            counts = sorted((r["digit"], r["n"]) for r in agree.groupBy(_digit(F.col(part), shift).alias("digit")).agg(F.count("*").alias("n")).collect())
            for digit, n in counts:  # noqa: B007
                if k <= n:
                    break
                k -= n
            prefix, shift = prefix << DIGIT | int(digit), shift - DIGIT
        key += (prefix,)
    return key


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text",
    target_col: str = "text", buckets: int = BUCKETS, run: int = RUN, seed: int = SEED,
) -> DataFrame:
    """Per row: id, n_words, n_features, weight, score, rank; rank is null for rows that are not drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets, run), bucket_counts(target, target_col, buckets, run), buckets)
    scored = materialize(weigh(docs, gain, id_col, text_col, run, seed))
    able = F.col("n_words") >= least_words
    seen = scored.where(able).agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    low, high = seen["low"] or 0, seen["high"] or 0
    # composite key, ascending: how far below the best score, how far above the smallest id, null ids last; offsets of ids
    # that are more than 2^62 apart do not fit a long, so the ids' upper and lower halves are parts of their own
    keys = {
        "below": F.lit(seen["top"]) - F.col("score"),
        "missing": F.col("id").isNull().cast("long"),
        "upper": F.shiftright("id", 32) - (low >> 32),
        "lower": F.coalesce(F.col("id"), F.lit(0)).bitwiseAND(0xFFFFFFFF),
        "more": F.col("n_features"),
    }
    keys["upper"] = F.coalesce(keys["upper"], F.lit(0))
    keyed = scored.where(able).select(*[c.cast("long").alias(name) for name, c in keys.items()])
    parts = [p for p in keys if p != "upper" or low >> 32 != high >> 32]
    drawn = seen["n"] * percent // 100
    last = kth_key(keyed, parts, drawn)
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    columns = ("id", "n_words", "n_features", "weight", "score")
    key = F.struct(*[keys[p].cast("long").alias(p) for p in parts])
    within = able & (key <= F.struct(*[F.lit(x).cast("long").alias(p) for p, x in zip(parts, last, strict=True)]))
    order = [F.col(f"key.{p}") for p in parts]
    # equal rows are counted before they are dealt out, so that one of them many times over is one row here
    chosen = scored.where(within).groupBy(*columns).agg(F.count("*").alias("n")).withColumn("key", key)
    ranged = materialize(chosen.repartitionByRange(max(1, -(-drawn // BLOCK_ROWS)), *order).withColumn("block", F.spark_partition_id()))
    sums = sorted((r["block"], r["n"]) for r in ranged.groupBy("block").agg(F.sum("n").alias("n")).collect())
    before = accumulate((n for _, n in sums[:-1]), initial=0)
    starts = docs.sparkSession.createDataFrame([(b, x) for (b, _), x in zip(sums, before, strict=True)], "block int, before long")
    upto = F.sum("n").over(Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranks = ranged.join(F.broadcast(starts), "block").withColumn("upto", F.col("before") + upto)
    rank = F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("rank")
    ranked = ranks.select(*columns, rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return scored.where(~within | within.isNull()).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)
