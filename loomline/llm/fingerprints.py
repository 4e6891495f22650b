"""Document fingerprints: threshold-scaled sketches.

A fingerprint keeps every hash of the text's word shingles that is below ``fraction`` of the hash range. The share is
fixed, not the size, so a long document's sketch holds a short one's: sketches merge by union, and containment and
Jaccard similarity are estimated without bias between documents of very unequal length. A text none of whose hashes
is below the threshold keeps its smallest hash, so that no text with words has an empty sketch; merging drops such a
hash again as soon as there is one below the threshold, so a merged sketch is that of both texts' shingles together.

A fingerprint is text: the sorted hashes in hexadecimal, 16 digits each, joined.

Defined cases: null and empty texts, and texts without words, have the empty fingerprint; two empty fingerprints have
likeness 1, an empty one and another 0; texts with fewer words than a shingle are one shingle; repeated rows have equal
fingerprints; an empty table gives no rows; texts of any length are whole; other columns are not returned, whatever
their names. ``with_next`` orders rows by id, ties by text, and rows of one id meet in one task, which sorts them on
disk; null ids are not in that order: such a row is followed by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import WordHash, block_bounds, block_number, hash_blocks, shingle_hashes, sized, texts_of, total_chars

SHINGLE, FRACTION = 5, 1 / 2
#: Characters of one block of consecutive ids, which one task sorts.
BLOCK_CHARS = 24_000_000


def _kept(hashes: np.ndarray, fraction: float) -> np.ndarray:
    """Sorted distinct hashes below the threshold, or the smallest hash."""
    kept = np.unique(hashes[hashes <= np.uint64(min(int(fraction * 2**64), 2**64 - 1))])
    return kept if len(kept) or not len(hashes) else hashes.min(keepdims=True)


def sketch(words: WordHash, text: bytes, size: int = SHINGLE, fraction: float = FRACTION) -> np.ndarray:
    return _kept(shingle_hashes(words.of(text.split()), size), fraction)


def as_text(kept: np.ndarray) -> str:
    return kept.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def merged(a: str, b: str, fraction: float = FRACTION) -> str:
    """Fingerprint of two documents together."""
    return as_text(_kept(np.concatenate((from_text(a), from_text(b))), fraction))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate of two sketches."""
    if not len(a) and not len(b):
        return 1.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Per row: id, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in sized(batches):
            found = [as_text(sketch(words, t, size, fraction)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, text, following): each row with the text that comes next by id, after the last the first.

    No global sort: rows go to blocks of consecutive ids. Every block opens with an id that is known beforehand, so
    the rows of that id are sent to the block before as well and close it; texts are shuffled once.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    _, chars = total_chars(docs, "text")
    bounds = block_bounds(docs, "id", "text", chars, block_chars)
    lowest = docs.agg(F.min("id").alias("id")).first()["id"]
    block = F.when(F.col("id").isNull(), hash_blocks(len(bounds) + 1)).otherwise(block_number("id", bounds))
    openers = [x for x in [lowest, *bounds] if x is not None]
    last = len(bounds)
    before = F.when(F.col("id") == lowest, F.lit(last)).otherwise(F.col("block") - 1) if openers else F.lit(0)
    opens = F.col("id").isin(openers) if openers else F.lit(False)
    placed = docs.withColumn("block", block).select(
        "id", "text", F.explode(F.when(opens, F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("guest")), F.struct(before.cast("int").alias("block"), F.lit(1).alias("guest"))))
        .otherwise(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("guest"))))).alias("at")
    ).select("id", "text", "at.block", "at.guest")
    own = F.col("id").isNotNull()
    order = Window.partitionBy("block").orderBy(F.when(own, F.lit(0)).otherwise(F.lit(-1)), "guest", "id", "text")
    followed = placed.withColumn("following", F.when(own, F.lead("text").over(order)).otherwise(F.col("text")))
    return followed.where("guest = 0").select("id", "text", "following")


def edited_text(text: str, following: str) -> F.Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - cut), F.substring(F.col(following), F.lit(1), cut))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Per row: id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, id_col, text_col).select("id", "text", "following", edited_text("text", "following").alias("edited"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        known, known_text = np.zeros(0, np.uint64), b""
        for batch in sized(batches):
            own, changed, near, onward = [], [], [], []
            for text, following, edited in zip(*(texts_of(batch.column(k)) for k in (1, 2, 3)), strict=True):
                a = known if text == known_text else sketch(words, text, size, fraction)  # rows come in order
                b = sketch(words, edited, size, fraction) if edited != text else a
                known, known_text = sketch(words, following, size, fraction), following
                own.append(as_text(a))
                changed.append(as_text(b))
                near.append(likeness(a, b))
                onward.append(likeness(a, known))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(own, pa.string()), pa.array(changed, pa.string()), pa.array(near, pa.float64()), pa.array(onward, pa.float64()), batch.column(4)],
                names=["id", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_chars"],
            )

    schema = "id long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chars long"
    return rows.withColumn("n_chars", F.length("text").cast("long")).mapInArrow(run, schema)
