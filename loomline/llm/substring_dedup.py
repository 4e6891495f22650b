"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark over all documents.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it has a word
sequence that also starts in a document with a smaller id; windows are judged on the input.

Plan. Documents are dealt into blocks by hash, so blocks are even however ids, lengths and sources lie. Each block
sends the sorted distinct hashes of its windows, cut by hash range, as packed differences, and the smallest id that
each has in the block. For each hash range one group finds the smallest id of all blocks and answers with one bit each:
whether another block has a smaller one; within a block the first document of a hash is known locally. Blocks then cut
their own texts. Hash ranges are even by construction, however often a passage or a document repeats, because a block
sends a hash once. The text is shuffled once: both passes over a block read the same exchange. Nothing is collected to
the driver but the number of characters.

Defined cases: null or empty texts have no words; a row whose id is null is kept whole and never compared; rows
with equal ids, repeated rows among them, never remove each other's words; an empty table gives no rows; texts of any
length are judged whole; other columns travel untouched in the struct ``row``, whatever their names.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import GOLDEN, WordHash, hash_blocks, mix64, pack_counts, pack_sorted, range_slices, texts_of, tidy, total_chars, unpack_counts, unpack_sorted

#: Characters of one block, which one Python worker holds at a time, and blocks at least; windows of one hash range.
BLOCK_CHARS, LEAST_BLOCKS = 5_000_000, 16
RANGE_WINDOWS = 1_500_000


class RabinKarp:
    """Hashes of all windows by prefix sums of word * B^i modulo 2^64; B is odd, so powers can be undone."""

    def __init__(self, window: int):
        self.window, self.words = window, WordHash()
        self.power = self.undo = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            size = 2 * n
            inverse = np.uint64(pow(int(GOLDEN), -1, 2**64))
            self.power, self.undo = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, f, np.uint64))), dtype=np.uint64) for f in (GOLDEN, inverse))

    def of(self, words: list[bytes]) -> np.ndarray:
        n, w = len(words), self.window
        if n < w:
            return np.zeros(0, np.uint64)
        self.grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words.of(words) * self.power[:n], out=sums[1:])
        return mix64((sums[w:] - sums[:-w]) * self.undo[: n - w + 1])


def _block_hashes(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Hashes of all windows of a block, documents in ascending id; ends of each document's run; texts; order; ids in order."""
    ids = table.column("id").to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0)), np.int64)
    texts = texts_of(table.column("text"))
    karp, parts = RabinKarp(window), []
    for i in order:
        parts.append(karp.of(texts[i].split()) if ids[i] is not None else np.zeros(0, np.uint64))
    ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, np.int64)
    number = np.array([ids[i] if ids[i] is not None else 0 for i in order], np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), ends, texts, order, number


def _owners(first: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The smallest id of each distinct hash, from its first place among all windows."""
    return number[np.searchsorted(ends, first, side="right")] if len(first) else np.zeros(0, np.int64)


def _send(window: int, bits: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tidy()
        hashes, ends, _, _, number = _block_hashes(table, window)
        found, first = np.unique(hashes, return_index=True)
        owner = _owners(first, ends, number)
        rows = [(r, pack_sorted(found[s]), pack_counts(owner[s])) for r, s in range_slices(found, bits)]
        return pa.table(
            {
                "range": pa.array([r[0] for r in rows], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "hashes": pa.array([r[1] for r in rows], pa.binary()),
                "owners": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    return send


def _mark(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one hash range: a bit for each block's hash, set if another block has it in a document with a smaller id."""
    tidy()
    blocks = table.column("block").to_pylist()
    parts = [unpack_sorted(h) for h in table.column("hashes").to_pylist()]
    hashes = np.concatenate(parts)
    owners = np.concatenate([unpack_counts(x) for x in table.column("owners").to_pylist()])
    order = np.argsort(hashes, kind="stable")  # runs are sorted already
    hashes, owners = hashes[order], owners[order]
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    least = np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.append(starts, len(owners))))
    repeats = np.zeros(len(hashes), bool)
    repeats[order] = least < owners
    ends = np.cumsum([len(p) for p in parts])
    return pa.table(
        {
            "range": pa.array([key[0].as_py()] * len(parts), pa.int32()),
            "block": pa.array(blocks, pa.int32()),
            "size": pa.array([len(p) for p in parts], pa.int64()),
            "bits": pa.array([np.packbits(repeats[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary()),
        }
    )


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words a window from ``starts`` covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, n), -1)
    return np.cumsum(steps[:-1]) > 0


def intervals(mask: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of set words as half-open intervals."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(window: int):
    def cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
        tidy()
        hashes, ends, texts, order, number = _block_hashes(docs, window)
        ids = docs.column("id")
        found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        rows = sorted(zip(marks.column("range").to_pylist(), marks.column("size").to_pylist(), marks.column("bits").to_pylist(), strict=True))
        seen = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, n, b in rows]
        earlier = np.concatenate(seen) if seen else np.zeros(0, bool)
        if len(earlier) != len(found):
            raise RuntimeError("marks do not fit the block they came from")
        owner = _owners(first, ends, number)
        counts, gone, spans, kept = [0] * len(ids), [0] * len(ids), [[]] * len(ids), [b""] * len(ids)
        start = 0
        for k, i in enumerate(order):
            words, end = texts[i].split(), int(ends[k])
            at = back[start:end]
            starts = np.flatnonzero(earlier[at] | (owner[at] < number[k]))
            start = end
            counts[i] = len(words)
            if len(starts):
                mask = covered(starts, window, len(words))
                gone[i], spans[i] = int(mask.sum()), intervals(mask)
                words = list(compress(words, ~mask))
            kept[i] = b" ".join(words)
        out = {
            "id": docs.column("id"),
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(gone, pa.int64()),
            "removed": pa.array(spans, SPANS),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
        if "row" in docs.column_names:
            out |= {"text": docs.column("text"), "row": docs.column("row")}
        return pa.table(out)

    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: id, n_words, n_removed, removed (intervals of words), kept (the words left, joined by a space).

    With ``carry``, also text and row, a struct of the input's other columns.
    """
    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row") if others else F.struct(F.lit(1).alias("none")).alias("row"))
    docs = docs.select(*cols)
    _, chars = total_chars(docs, "text")
    bits = max(0, int(np.ceil(np.log2(max(1, chars / 5 / RANGE_WINDOWS)))))
    blocks = docs.select(hash_blocks(max(LEAST_BLOCKS, -(-chars // block_chars))).alias("block"), *docs.columns)
    marks = (
        blocks.groupBy("block").applyInArrow(_send(window, bits), "range int, block int, hashes binary, owners binary")
        .groupBy("range").applyInArrow(_mark, "range int, block int, size long, bits binary")
    )
    schema = "id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
    if carry:
        schema += f", text string, row {blocks.schema['row'].dataType.simpleString()}"
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cut(window), schema)
