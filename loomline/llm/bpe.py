"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so text is cut there with
certainty. Every piece of the public pre-tokenizer pattern is cut at such pairs, each fragment is merged on its own
(and remembered), and the fragments' ids are concatenated; the result equals merging the whole piece.

The vocabulary file is a parameter. The driver reads it once and broadcasts its bytes, whose size is checked.

Defined cases: null and empty texts have no ids and decode to the empty string; special tokens' strings in a text
become their ids, as in the library's default; ids that no token has raise; rows with null or repeated ids are encoded
each; an empty table gives no rows; texts of any length are encoded whole; other columns are not returned, whatever
their names.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import sized

#: The public pre-tokenizer pattern of the byte-level family (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Largest vocabulary file that is broadcast; pieces and fragments one worker remembers before it starts afresh.
MAX_VOCABULARY_BYTES = 64 << 20
PIECE_MEMO, FRAGMENT_MEMO = 400_000, 100_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Pieces(dict):
    """Piece to its ids as little-endian 32-bit integers."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECE_MEMO:
            self.clear()
        found = self[piece] = self.bpe.piece_ids(piece.encode())
        return found


class Bpe:
    """A byte-level vocabulary with its merges and its forced boundaries."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        to_byte = byte_alphabet()
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        vocab = {as_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.ranks, self.joined = {}, []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (as_bytes(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            self.ranks.setdefault(vocab[left] << 32 | vocab[right], rank)
            self.joined.append(vocab[left + right])
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            for a, b in zip(token, token[1:], strict=False):
                self.inside[a, b] = True
        self.token = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.cut_pairs = frozenset(bytes(p) for p in np.argwhere(~self.inside).astype(np.uint8).tolist())
        self.fragments: dict[bytes, bytes] = {}
        self.pieces = _Pieces(self)
        self.find = regex.compile(PIECES).findall

    def split_forced(self, piece: bytes) -> list[bytes]:
        """Fragments between the byte pairs that occur inside no token."""
        cut_pairs, n = self.cut_pairs, len(piece)
        cuts = [k for k in range(1, n) if piece[k - 1 : k + 1] in cut_pairs]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)] if cuts else [piece]

    def merge(self, fragment: bytes) -> bytes:
        """Ids of a fragment: the pair of lowest rank is joined, leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in fragment]
        if len(ids) > 64:
            ids = self._merge_long(ids)
        elif len(ids) > 1:
            rank_of, joined, none = self.ranks.get, self.joined, len(self.joined)
            ranks = [rank_of(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
            while ranks and (best := min(ranks)) < none:
                k = ranks.index(best)
                ids[k] = joined[best]
                del ids[k + 1], ranks[k]
                if k < len(ranks):
                    ranks[k] = rank_of(ids[k] << 32 | ids[k + 1], none)
                if k:
                    ranks[k - 1] = rank_of(ids[k - 1] << 32 | ids[k], none)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n steps for a fragment of n bytes."""
        n, rank_of, joined = len(ids), self.ranks.get, self.joined
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := rank_of(ids[k] << 32 | ids[k + 1])) is not None]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or rank_of(ids[k] << 32 | ids[j]) != rank:
                continue
            ids[k], ids[j] = joined[rank], -1
            after[k], after[j] = after[j], -1
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and (right := after[left]) >= 0 and (r := rank_of(ids[left] << 32 | ids[right])) is not None:
                    heappush(heap, (r, left))
        return [i for i in ids if i >= 0]

    def piece_ids(self, piece: bytes) -> bytes:
        out = []
        for fragment in self.split_forced(piece):
            ids = self.fragments.get(fragment)
            if ids is None:
                if len(self.fragments) >= FRAGMENT_MEMO:
                    self.fragments.clear()
                ids = self.fragments[fragment] = self.merge(fragment)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.special_split and any(s in text for s in self.special):
            return b"".join(np.array([self.special[t]], "<u4").tobytes() if t in self.special else self._encode(t) for t in self.special_split.split(text) if t)
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(data: bytes) -> Bpe:
    return Bpe(data)


def _vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {MAX_VOCABULARY_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids (little-endian unsigned 32-bit integers); with ``decoded`` also their text."""
    shared = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for batch in sized(batches):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            out = [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array([bpe.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["id", "n_tokens", "ids", "decoded"][: len(out)])

    schema = "id long, n_tokens long, ids binary" + ", decoded string" * decoded
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, text of the ids; null ids decode to the empty string."""
    shared = _vocabulary(coded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for batch in sized(batches):
            texts = [bpe.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")
