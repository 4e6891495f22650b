"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are word sequences (lower-cased runs of letters, digits and underscores). A document holds an item of
m words if some run of its words is within k = floor(m * (100 - percent) / 100) word edits of it.

For an item, every window of m words is a candidate place. The CGK embedding walks a window with a random function of
(step, word): it writes the current word and moves on or stays; edit distance k becomes Hamming distance of order k^2
at most and close to 2k for typical edits. Each of ``repetitions`` tables has its own walk and samples ``sampled``
steps of the embedding as key; the number of tables follows from the target recall at the stated share of differing
steps. Windows whose key equals an item's are verified by exact semi-global edit distance around the window.

Before the walks, a window must hold enough runs of g words of some item: k edits break at most g * k of an item's
m - g + 1 runs, and g is the largest of 3, 2 and 1 that leaves some, so this filter loses nothing, and it leaves few
windows. Windows of a whole batch of texts walk at once. Items too short for an edit are found exactly: an equal
window has equal keys.

The benchmark is broadcast in chunks of at most ``chunk_bytes`` of text, one pass over the documents each, so its size
has no limit; documents are never shuffled but for the few rows of the result.

Defined cases: null and empty texts hold nothing; items without words are never reported, nor are items with a null id;
with ``min_words`` shorter items are left out; repeated items and rows are reported each; ties of one item in a document
go to the smallest distance, then the earliest place; empty tables give no rows; texts of any length are searched whole;
``contaminated`` returns no other columns, ``clean`` all of them, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import GOLDEN, mix64, shingle_hashes, sized

WORD = re.compile(r"\w+")
MIN_WORDS, TARGET_RECALL, SAMPLED, DIFFERING = 1, 0.99, 3, 0.5


def repetitions(recall: float = TARGET_RECALL, sampled: int = SAMPLED, differing: float = DIFFERING) -> int:
    """Tables after which a pair whose embeddings differ in a share of steps is found with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing) ** sampled))


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def edits_allowed(m: int, percent: int) -> int:
    return m * (100 - percent) // 100


def sampled_steps(m: int, seed: int, sampled: int) -> np.ndarray:
    """The steps of the embedding of an m-word window that one table samples."""
    return np.sort(np.random.default_rng((seed, m)).choice(3 * m, sampled, replace=False))


def cgk_keys(windows: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Keys [rows, tables] of word-number windows [rows, width] whose first lengths[row] words count.

    ``steps`` [rows, tables, sampled] are the sampled steps; a walk that has passed its window's end writes 0.
    All rows and tables walk at once.
    """
    rows, tables, sampled = steps.shape
    padded = np.concatenate((windows, np.zeros((rows, 1), windows.dtype)), axis=1)
    line, ends = np.repeat(np.arange(rows), tables), np.repeat(lengths, tables)
    seeds = np.tile(np.arange(tables, dtype=np.uint64) << np.uint64(20), rows)
    at = np.zeros(rows * tables, np.int64)
    written = np.zeros((int(steps.max()) + 1, rows * tables), np.uint64)
    for j in range(len(written)):
        word = np.where(at < ends, padded[line, np.minimum(at, ends)], 0).astype(np.uint64)
        written[j] = word
        move = mix64(word * GOLDEN + seeds + np.uint64(j + 1))
        at += (move >> np.uint64(63)).astype(np.int64)
    flat = steps.reshape(rows * tables, sampled)
    key = seeds + ends.astype(np.uint64)
    for k in range(sampled):
        key = mix64(key * GOLDEN + written[flat[:, k], np.arange(rows * tables)])
    return key.reshape(rows, tables)


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to any run of the text, and that run's first (start, end)."""
    n = len(text)
    row, start, steps = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for k, word in enumerate(item, 1):
        swap, drop = row[:-1] + (text != word), row[1:] + 1
        new = np.concatenate(([k], np.minimum(swap, drop)))
        origin = np.concatenate(([0], np.where(swap <= drop, start[:-1], start[1:])))
        low = np.minimum.accumulate(new - steps)  # words of the text that the item lacks, one edit each
        source = np.maximum.accumulate(np.where(new - steps == low, steps, 0))
        row, start = low + steps, origin[source]
    end = int(np.argmin(row))
    return int(row[end]), int(start[end]), end


class Matcher:
    """A benchmark's items, their word runs and their LSH keys."""

    def __init__(self, items: list[tuple[int, str]], percent: int, recall: float, min_words: int):
        self.percent, self.tables = percent, repetitions(recall)
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            words = words_of(text)
            if len(words) >= max(1, min_words):
                self.items.append((item, np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)))
        self.memo, self.width = _Numbers(self.number), len(self.number) + 1
        if not self.items:
            return
        self.m = np.array([len(w) for _, w in self.items])
        self.k = np.array([edits_allowed(int(m), percent) for m in self.m])
        # k edits break at most g * k of the m - g + 1 runs of g words; longer runs tell more where enough are left
        self.gram = np.where(self.m - 2 - 3 * self.k >= 2, 3, np.where(self.m - 1 - 2 * self.k >= 1, 2, 1))
        self.need = self.m - self.gram + 1 - self.gram * self.k
        self.runs = {}
        for g in np.unique(self.gram).tolist():
            own = [(i, np.unique(shingle_hashes(w.astype(np.uint64), g))) for i, (_, w) in enumerate(self.items) if self.gram[i] == g]
            codes, holders = np.concatenate([c for _, c in own]), np.repeat([i for i, _ in own], [len(c) for _, c in own])
            order = np.argsort(codes, kind="stable")
            values, first = np.unique(codes[order], return_index=True)
            self.runs[g] = (values, holders[order], first, np.diff(np.append(first, len(codes))), int(min(self.need[i] for i, _ in own)))
        self.steps = {int(m): np.stack([sampled_steps(int(m), t, SAMPLED) for t in range(self.tables)]) for m in np.unique(self.m)}
        self.keys = self._keys([w for _, w in self.items])

    def _keys(self, windows: list[np.ndarray], at_once: int = 512) -> np.ndarray:
        out = []
        for s in range(0, len(windows), at_once):
            part = windows[s : s + at_once]
            lengths = np.array([len(w) for w in part])
            block = np.zeros((len(part), lengths.max()), np.int64)
            for row, w in zip(block, part, strict=True):
                row[: len(w)] = w
            out.append(cgk_keys(block, lengths, np.stack([self.steps[int(m)] for m in lengths])))
        return np.concatenate(out) if out else np.zeros((0, self.tables), np.uint64)

    def _numbers(self, text: str) -> np.ndarray:
        tokens = WORD.findall(text)
        return np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))

    def _starts(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items with the starts of item-sized windows that hold enough of their word runs."""
        known = ids > 0
        for g, (values, holders, first, count, least) in self.runs.items():
            if len(ids) < g:
                continue
            at = np.flatnonzero(known[: len(ids) - g + 1] & known[g - 1 :] & (known[1 : len(ids) - g + 2] if g == 3 else True))
            if len(at) < least:
                continue
            codes = shingle_hashes(np.stack([ids[at + k] for k in range(g)], axis=1).astype(np.uint64).ravel(), g)[::g]
            slot = np.minimum(np.searchsorted(values, codes), len(values) - 1)
            hit = values[slot] == codes
            at, slot = at[hit], slot[hit]
            if len(at) < least:
                continue
            times = count[slot]
            place = np.repeat(at, times)
            offset = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
            holder = holders[np.repeat(first[slot], times) + offset]
            for i in np.flatnonzero(np.bincount(holder, minlength=len(self.items)) >= self.need):
                p, m, need = place[holder == i], int(self.m[i]), int(self.need[i])
                lo, hi = p[need - 1 :] - (m - g), p[: len(p) - need + 1]
                spans = [np.arange(max(0, a), b + 1) for a, b in zip(lo, hi, strict=True) if a <= b]
                if spans:
                    yield int(i), np.unique(np.concatenate(spans))

    def places(self, texts: list[str]) -> list[list[dict]]:
        """For each text the items in it: item, distance, and the character span of the first best place."""
        found: list[list[dict]] = [[] for _ in texts]
        if not self.items:
            return found
        windows, origin, numbers = [], [], {}
        for d, text in enumerate(texts):
            ids = self._numbers(text)
            for i, starts in self._starts(ids):
                m = int(self.m[i])
                padded = np.concatenate((ids, np.zeros(m, np.int64)))
                numbers[d] = ids
                for s in starts.tolist():
                    windows.append(padded[s : s + m])
                    origin.append((d, i, s))
        if not windows:
            return found
        # a window meets its item if some table gives both the same key
        meets = (self._keys(windows) == self.keys[[i for _, i, _ in origin]]).any(axis=1)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (d, i), near in groupby(compress(origin, meets), key=lambda x: x[:2]):
            m, k = int(self.m[i]), int(self.k[i])
            for lo, hi in _runs([s for _, _, s in near], m):
                lo = max(0, lo - k)
                distance, a, b = best_place(self.items[i][1], numbers[d][lo : hi + m + k])
                if distance <= k:
                    best[d, i] = min(best.get((d, i), (distance, lo + a, lo + b)), (distance, lo + a, lo + b))
        for (d, i), (distance, a, b) in sorted(best.items()):
            spans = [x.span() for x in WORD.finditer(texts[d])]
            found[d].append({"item": self.items[i][0], "distance": distance, "n_item_words": int(self.m[i]), "start": spans[a][0], "end": spans[max(a, b - 1)][1]})
        return found


def _runs(starts: list[int], reach: int) -> list[tuple[int, int]]:
    """First and last of ascending starts that lie within reach of one another: they are verified together."""
    runs = [[starts[0], starts[0]]]
    for s in starts[1:]:
        if s - runs[-1][1] <= reach:
            runs[-1][1] = s
        else:
            runs.append([s, s])
    return [(a, b) for a, b in runs]


class _Numbers(dict):
    """Words as they stand in a text to the benchmark's word numbers; 0 for words it lacks."""

    def __init__(self, number: dict[str, int]):
        self.number = number

    def __missing__(self, word: str) -> int:
        if len(self) >= 250_000:
            self.clear()
        found = self[word] = self.number.get(word.lower(), 0)
        return found


SCHEMA = "id long, item long, distance long, n_item_words long, start long, end long"


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, chunk_bytes: int) -> Iterator[list[tuple[int, str]]]:
    chunk, held = [], 0
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    for row in items.orderBy("item", "text").toLocalIterator():
        chunk.append((row["item"], row["text"]))
        held += len(row["text"].encode())
        if held >= chunk_bytes:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    percent: int = 80, recall: float = TARGET_RECALL, min_words: int = MIN_WORDS, chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """Per (row, item) held: id, item, distance in words, n_item_words, character span [start, end)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def matched(chunk: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((chunk, percent, recall, min_words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in sized(batches):
                places = matcher.places([t or "" for t in batch.column(1).to_pylist()])
                rows = [{"id": i} | p for i, found in zip(batch.column(0).to_pylist(), places, strict=True) for p in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], pa.int64()) for c in ("id", "item", "distance", "n_item_words", "start", "end")],
                    names=["id", "item", "distance", "n_item_words", "start", "end"],
                )

        return texts.mapInArrow(run, SCHEMA)

    found = [matched(chunk) for chunk in _chunks(benchmark, item_col, item_text_col, chunk_bytes)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], SCHEMA)


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    percent: int = 80, recall: float = TARGET_RECALL, min_words: int = MIN_WORDS, chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for chunk in _chunks(benchmark, item_col, item_text_col, chunk_bytes):
        shared = spark.sparkContext.broadcast((chunk, percent, recall, min_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in sized(batches):
                yield batch.filter(pa.array([not found for found in matcher.places([t or "" for t in batch.column(at).to_pylist()])], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
