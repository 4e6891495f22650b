"""LM scoring by cross-entropy difference.

Two bigram models, of the target texts and of all texts (the background), are matched: one vocabulary, one smoothing.
A token's loss is -log2 of

    mix * count(previous, word) / count(previous) + (1 - mix) * (count(word) + 1) / (words + vocabulary size)

and a document's score is its mean background loss less its mean target loss: high if it reads like the target.

The vocabulary is every distinct word and one unknown word; words are lower-cased. Counts are exact 64-bit integers but
for meetings of hashes. They stay in Spark as packed sorted keys by hash range, and ranges grow in number with the
corpus: every task sends each distinct word and bigram of its texts once, ranges add them up, and to score, blocks of
documents ask the ranges for the counts of their distinct words and bigrams. No key is common enough to fill a task,
and nothing of the corpus goes to the driver but sums.

``score_corpus`` scores the documents that the models were counted on. A document's own counts are left out of both
models there, so that it does not vouch for itself: its words count only as often as other documents have them. Blocks
of documents send their counts once and get the sums of all blocks for just those keys back, so training and scoring
are one exchange. ``train`` and ``score`` are for scoring other documents.

``vocabulary`` and ``table_bits`` make smaller models: only the ``vocabulary`` most frequent words (ties by word) are
told apart, and bigrams share 2^table_bits cells. Neither is set by default. Keys have 44 bits more than it takes to
number the ranges, so the chance that a key meets another, about one in ten million, does not grow with the corpus.

Defined cases: null and empty texts have no tokens and score 0; without target texts the target model is uniform over
the vocabulary; rows with null ids are scored and counted; repeated rows count repeatedly, each for the other; an empty
table gives no rows; texts of any length are counted whole; other columns are not returned, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import GOLDEN, WordHash, hash_blocks, materialize, mix64, pack_counts, pack_sorted, range_slices, release, sized, texts_of, tidy, total_chars, unpack_counts, unpack_sorted

MIX = 0.6
#: Hashes of the start of a text and of words outside a given vocabulary.
START, UNKNOWN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Characters that a block of documents, and a hash range, stand for; blocks at least; tokens that a task counts at a time.
BLOCK_CHARS, RANGE_CHARS, LEAST_BLOCKS, CHUNK_TOKENS = 8_000_000, 32_000_000, 16, 2_000_000
LEAST_RANGE_BITS, KEY_BITS = 5, 44
PACKED = "range int, keys binary, target binary, background binary, n_keys long, n_target long, n_background long"


class _Known(WordHash):
    """Hashes of the given words; others are one unknown word."""

    def __init__(self, words: set[bytes] | None):
        self.known = words

    def __missing__(self, word: bytes) -> int:
        if self.known is not None and word not in self.known:
            return int(UNKNOWN)
        return super().__missing__(word)


@dataclass
class Model:
    """Packed counts of words and bigrams by range, tokens of target and background, and what makes the keys."""

    counts: DataFrame
    tokens: tuple[int, int]
    size: int
    words: set[bytes] | None
    table_bits: int | None
    range_bits: int
    mix: float


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)) << np.uint64(64 - bits)


def _keys(words: WordHash, texts: list[bytes], table_bits: int | None, range_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens of the texts one after another, of the tokens before them and of the bigrams; tokens per text."""
    own = [words.of(t.lower().split()) for t in texts]
    n = np.array([len(x) for x in own], np.int64)
    ids = mix64(np.concatenate(own)) if len(own) else np.zeros(0, np.uint64)
    before = np.roll(ids, 1)
    before[(np.cumsum(n) - n)[n > 0]] = START
    pairs = mix64(mix64(before * GOLDEN + np.uint64(1)) + ids)
    bits = min(64, KEY_BITS + range_bits)
    return _cells(ids, bits), _cells(before, bits), _cells(pairs, min(bits, table_bits or bits)), n


def _start(range_bits: int) -> np.uint64:
    return _cells(np.array([START]), min(64, KEY_BITS + range_bits))[0]


def _by_range(keys: np.ndarray, kind: int, range_bits: int) -> Iterator[tuple[int, slice]]:
    """Ranges of words (kind 0) come before those of bigrams (kind 1)."""
    if len(keys):
        for r, s in range_slices(keys, range_bits):
            yield (kind << range_bits) + r, s


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count) of a task's texts, sent whenever many distinct words have gathered."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in sized(batches):
        for text in texts_of(batch.column(0)):
            counts.update(text.lower().split())
        if len(counts) > 300_000:
            yield sent(counts)
            counts = Counter()
    if counts:
        yield sent(counts)


def _packed(rows: list[tuple]) -> dict[str, pa.Array]:
    names = [x.split()[0] for x in PACKED.split(", ")]
    types = [pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 3]
    return {c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, types, strict=True))}


def _row(r: int, keys: np.ndarray, target: np.ndarray, background: np.ndarray) -> tuple:
    return r, pack_sorted(keys), pack_counts(target), pack_counts(background), len(keys), int(target.sum()), int(background.sum())


def _counts(keys: tuple[np.ndarray, ...], target: list[bool], range_bits: int) -> list[tuple]:
    """Rows of the counts of texts' words, with the start, and bigrams by range."""
    ids, before, pairs, n = keys
    marked = np.repeat(np.array(target, bool), n)
    first = before == _start(range_bits)
    rows = []
    for kind, own, good in ((0, np.concatenate((ids, before[first])), np.concatenate((marked, marked[first]))), (1, pairs, marked)):
        found, back, times = np.unique(own, return_inverse=True, return_counts=True)
        mine = np.bincount(back, good, len(found)).astype(np.int64)
        rows += [_row(r, found[s], mine[s], times[s]) for r, s in _by_range(found, kind, range_bits)]
    return rows


def _counted(known, table_bits: int | None, range_bits: int):
    """Packed counts of a task's words, starts and bigrams by range, sent whenever many tokens have gathered."""

    def sent(words: WordHash, texts: list[bytes], target: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(_packed(_counts(_keys(words, texts, table_bits, range_bits), target, range_bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, texts, target, chars = _Known(known.value), [], [], 0
        for batch in sized(batches):
            for good, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                texts.append(text)
                target.append(good)
                chars += len(text)
                if chars > 5 * CHUNK_TOKENS:
                    yield sent(words, texts, target)
                    texts, target, chars = [], [], 0
        if texts:
            yield sent(words, texts, target)

    return run


def _added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One range's counts over all tasks, packed again."""
    found, back = np.unique(np.concatenate([unpack_sorted(k) for k in table.column("keys").to_pylist()]), return_inverse=True)
    sums = [np.bincount(back, np.concatenate([unpack_counts(x) for x in table.column(c).to_pylist()]), len(found)).astype(np.int64) for c in ("target", "background")]
    return pa.table(_packed([_row(key[0].as_py(), found, *sums)]))


def _range_bits(chars: int) -> int:
    return max(LEAST_RANGE_BITS, (chars // RANGE_CHARS).bit_length())


def train(docs: DataFrame, target: F.Column, text_col: str = "text", vocabulary: int | None = None, table_bits: int | None = None, mix: float = MIX) -> Model:
    """Both models from all rows of ``docs``; ``target`` marks the target's rows."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(target, F.lit(False)).alias("target"), F.col(text_col).cast("string").alias("text"))
    words = None
    if vocabulary is not None:
        counts = rows.select("text").mapInArrow(_counted_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        words = {bytes(r["word"]) for r in counts.orderBy(F.col("n").desc(), "word").limit(vocabulary).collect()}
    range_bits = _range_bits(total_chars(rows, "text")[1])
    counts = materialize(rows.mapInArrow(_counted(spark.sparkContext.broadcast(words), table_bits, range_bits), PACKED).groupBy("range").applyInArrow(_added, PACKED))
    pair = F.col("range") >= 1 << range_bits
    total = counts.agg(*[F.sum(F.when(pair, F.col(c))).alias(c) for c in ("n_target", "n_background")], F.sum(F.when(~pair, F.col("n_keys"))).alias("n_words")).first()
    release(spark)  # the shuffle files of the counts go before those of the scores come
    size = len(words) if words is not None else max((total["n_words"] or 0) - 1, 0)  # the start is no word
    return Model(counts, (total["n_target"] or 0, total["n_background"] or 0), size + 1, words, table_bits, range_bits, mix)


def _losses(seen: np.ndarray, both: np.ndarray, own: np.ndarray, tokens: int | np.ndarray, size: int, mix: float) -> np.ndarray:
    """Bits of tokens by the counts of the token before, of the bigram and of the token."""
    joint = np.minimum(both, seen) / np.maximum(seen, 1)
    return -np.log2(mix * joint + (1 - mix) * (own + 1) / (tokens + size))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, target_loss, background_loss (mean bits a token) and score, their difference."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(model.words)
    table_bits, range_bits, tokens, size, mix = model.table_bits, model.range_bits, model.tokens, model.size, model.mix
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, -(-total_chars(rows, "text")[1] // BLOCK_CHARS))
    rows = rows.withColumn("block", hash_blocks(blocks))

    def asked(ids: np.ndarray, pairs: np.ndarray) -> list[np.ndarray]:
        """Distinct keys of words, with the start, and of bigrams."""
        return [np.unique(np.append(ids, _start(range_bits))), np.unique(pairs)]

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, _, pairs, _ = _keys(_Known(known.value), texts_of(table.column("text")), table_bits, range_bits)
        out = [(r, key[0].as_py(), pack_sorted(keys[s])) for kind, keys in enumerate(asked(ids, pairs)) for r, s in _by_range(keys, kind, range_bits)]
        return pa.table({"range": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([x[1] for x in out], pa.int32()), "keys": pa.array([x[2] for x in out], pa.binary())})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts of the asked keys in their order; 0 for keys that the model lacks."""
        have = [unpack_sorted(right["keys"][0].as_py()), *(unpack_counts(right[c][0].as_py()) for c in ("target", "background"))] if len(right) else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2]
        out = {"target": [], "background": []}
        for packed in left["keys"].to_pylist():
            keys = unpack_sorted(packed)
            at = np.minimum(np.searchsorted(have[0], keys), max(len(have[0]) - 1, 0))
            hit = have[0][at] == keys if len(have[0]) else np.zeros(len(keys), bool)
            for c, counts in zip(out, have[1:], strict=True):
                out[c].append(pack_counts(np.where(hit, counts[at], 0) if len(counts) else np.zeros(len(keys), np.int64)))
        return pa.table({"block": left["block"].cast(pa.int32()), "range": left["range"].cast(pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in out.items()}})

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, before, pairs, n = _keys(_Known(known.value), texts_of(left.column("text")), table_bits, range_bits)
        keys = asked(ids, pairs)
        order = np.argsort(right["range"].to_numpy())
        doc, at = np.repeat(np.arange(len(n)), n), [np.searchsorted(k, x) for k, x in ((keys[0], before), (keys[1], pairs), (keys[0], ids))]
        mean = []
        for c, total in zip(("target", "background"), tokens, strict=True):
            packed = right[c].to_pylist()
            counts = np.concatenate([unpack_counts(packed[k]) for k in order])
            word, pair = counts[: len(keys[0])], counts[len(keys[0]) :]
            mean.append(np.bincount(doc, _losses(word[at[0]], pair[at[1]], word[at[2]], total, size, mix), len(n)) / np.maximum(n, 1))
        return pa.table({"id": left["id"], "n_tokens": pa.array(n), "target_loss": pa.array(mean[0]), "background_loss": pa.array(mean[1]), "score": pa.array(mean[1] - mean[0])})

    asks = rows.groupBy("block").applyInArrow(ask, "range int, block int, keys binary")
    answers = asks.groupBy("range").cogroup(model.counts.select("range", "keys", "target", "background").groupBy("range")).applyInArrow(answer, "block int, range int, target binary, background binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, "id long, n_tokens long, target_loss double, background_loss double, score double")


def _own(doc: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """For each token, how often its document has the key in that slot."""
    _, back, times = np.unique(doc * np.int64(slots) + slot, return_inverse=True, return_counts=True)
    return times[back]


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One range's sums over all blocks, for each block's keys in their order; the range's totals stand in its first row."""
    blocks, parts = table.column("block").to_pylist(), [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    found, back = np.unique(np.concatenate(parts), return_inverse=True)
    ends = np.cumsum([len(p) for p in parts])
    out, total = {}, {}
    for c in ("target", "background"):
        sums = np.bincount(back, np.concatenate([unpack_counts(x) for x in table.column(c).to_pylist()]), len(found)).astype(np.int64)
        total[c], all_sums = int(sums.sum()), sums[back]
        out[c] = pa.array([pack_counts(all_sums[e - len(p) : e]) for p, e in zip(parts, ends, strict=True)], pa.binary())
    once = lambda n: pa.array([n, *[0] * (len(parts) - 1)], pa.int64())
    return pa.table({"block": pa.array(blocks, pa.int32()), "range": pa.array([key[0].as_py()] * len(parts), pa.int32()), **out, "n_keys": once(len(found)), "n_target": once(total["target"]), "n_background": once(total["background"])})


def score_corpus(docs: DataFrame, target: F.Column, id_col: str = "doc_id", text_col: str = "text", table_bits: int | None = None, mix: float = MIX) -> DataFrame:
    """As ``score`` of ``docs`` by models of the same rows, each row's own counts left out; ``target`` marks the target's rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    chars = total_chars(rows, "text")[1]
    range_bits = _range_bits(chars)
    rows = rows.withColumn("block", hash_blocks(max(LEAST_BLOCKS, -(-chars // BLOCK_CHARS))))

    def keys_of(table: pa.Table) -> tuple[np.ndarray, ...]:
        return _keys(WordHash(), texts_of(table.column("text")), table_bits, range_bits)

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tidy()
        sent = _counts(keys_of(table), table.column("target").to_pylist(), range_bits)
        return pa.table({"block": pa.array([key[0].as_py()] * len(sent), pa.int32()), **{c: x for c, x in _packed(sent).items() if c[:2] != "n_"}})

    sends = rows.groupBy("block").applyInArrow(send, "block int, range int, keys binary, target binary, background binary")
    sums = materialize(sends.groupBy("range").applyInArrow(_summed, "block int, range int, target binary, background binary, n_keys long, n_target long, n_background long"))
    pair = F.col("range") >= 1 << range_bits
    total = sums.agg(*[F.sum(F.when(pair, F.col(c))).alias(c) for c in ("n_target", "n_background")], F.sum(F.when(~pair, F.col("n_keys"))).alias("n_words")).first()
    release(docs.sparkSession)
    tokens, size = (total["n_target"] or 0, total["n_background"] or 0), max((total["n_words"] or 0) - 1, 0) + 1  # the start is no word

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        tidy()
        ids, before, pairs, n = keys_of(left)
        doc = np.repeat(np.arange(len(n)), n)
        words, slot = np.unique(np.concatenate((ids, before)), return_inverse=True)
        both, pair_slot = np.unique(pairs, return_inverse=True)
        word_slot, before_slot = slot[: len(ids)], slot[len(ids) :]
        # of its own document: the word before as a word or as the start, the bigram, the word
        seen_own = _own(doc, before_slot, len(words))
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        # the last word of a text is before nothing, but counts as a word
        ends = np.unique(doc[last] * np.int64(len(words)) + word_slot[last]) if len(doc) else np.zeros(0, np.int64)
        seen_own = seen_own + np.isin(doc * np.int64(len(words)) + before_slot, ends)
        own = (seen_own, _own(doc, pair_slot, len(both)), _own(doc, word_slot, len(words)))
        order = np.argsort(right["range"].to_numpy())
        good = np.array(left.column("target").to_pylist(), bool)
        mean = []
        for c, all_tokens, part in zip(("target", "background"), tokens, (good, np.ones(len(n), bool)), strict=True):
            packed = right[c].to_pylist()
            counts = np.concatenate([unpack_counts(packed[k]) for k in order]) if len(order) else np.zeros(0, np.int64)
            word, pair_counts = counts[: len(words)], counts[len(words) :]
            less = part[doc].astype(np.int64)
            others = (all_tokens - np.where(part, n, 0))[doc]
            losses = _losses(word[before_slot] - less * own[0], pair_counts[pair_slot] - less * own[1], word[word_slot] - less * own[2], others, size, mix)
            mean.append(np.bincount(doc, losses, len(n)) / np.maximum(n, 1))
        return pa.table({"id": left["id"], "n_tokens": pa.array(n), "target_loss": pa.array(mean[0]), "background_loss": pa.array(mean[1]), "score": pa.array(mean[1] - mean[0])})

    schema = "id long, n_tokens long, target_loss double, background_loss double, score double"
    return rows.groupBy("block").cogroup(sums.select("block", "range", "target", "background").groupBy("block")).applyInArrow(scored, schema)
