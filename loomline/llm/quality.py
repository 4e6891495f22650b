"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is described by shares of word shapes and of
hashed words, encoded as h = tanh(W x + c), weighted by gated attention
a_k ~ exp(u . (tanh(V h_k) * sigmoid(U h_k))), and the weighted passage representation gives the score
sigmoid(o . sum(a_k h_k) + b). All of W, V, U, u, o are learned from document labels.

Fitting uses a bounded sample of labelled rows: at most ``sample``, half of each label, in an order by hash of the
id, weighted back to the ratio of all labels, so that a score means the same at every size of the table. Features are made on the executors; the driver gets those of the sample, every passage of every whole text, about
half a byte a character. Scoring uses every passage of every whole text. The model has a fixed size.

Defined cases: null and empty texts are one passage without words, scored like any other; without labelled rows of
both kinds the score is the share of label 1 (0.5 if there are no labels); null labels and null ids are not learned
from; repeated rows score alike; ties of attention go to the first passage; an empty table gives no rows; other columns
are not returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from loomline.llm.common import WORD_CACHE, sized, texts_of

PASSAGE_WORDS = 64
BUCKETS, SHAPES = 24, 20
FEATURES = BUCKETS + SHAPES + 4


def word_code(word: bytes) -> int:
    """Hash of a word whose low bits are replaced: 5 for a bucket, SHAPES for the shapes it has."""
    n = len(word)
    letters = word.strip(b".,;:!?\"'()[]")
    upper, digits = letters.isupper(), sum(48 <= c < 58 for c in word)
    odd = sum(not (c > 127 or 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123) for c in word)
    tail = word[-2:]
    shapes = (
        n == 1, n in (2, 3), 4 <= n <= 7, 8 <= n <= 12, 13 <= n <= 20, n > 20,
        upper and n > 1, word[:1].isupper(), digits == n, 0 < digits < n, odd == n, odd == 1, odd == 2, odd > 2,
        word in (b"|", b"-", b"*", b"#"), len(tail) == 2 and tail[0] == tail[1] and odd >= 2, word.endswith((b".", b"!", b"?")), word.endswith(b","),
        b"/" in word or b"@" in word, max(word, default=0) > 127,
    )
    h = xxh3_64_intdigest(word)
    return (h >> 25 << 25) | (h & 0xFFFF) % BUCKETS << SHAPES | sum(1 << k for k, s in enumerate(shapes) if s)


class WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        code = self[word] = word_code(word)
        return code


def passages(codes: WordCodes, text: bytes) -> np.ndarray:
    """A row of FEATURES for each passage of a text, all of it; at least one row."""
    words = text.split()
    n = len(words)
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, n)
    count = max(1, -(-n // PASSAGE_WORDS))
    x = np.zeros((count, FEATURES), np.float32)
    if n:
        at = np.arange(n) // PASSAGE_WORDS
        bucket = (code >> np.uint64(SHAPES)).astype(np.int64) & 31
        x[:, :BUCKETS] = np.bincount(at * BUCKETS + bucket, minlength=count * BUCKETS).reshape(count, BUCKETS)
        starts = np.arange(0, n, PASSAGE_WORDS)
        shape = (code[:, None] >> np.arange(SHAPES, dtype=np.uint64)) & np.uint64(1)
        x[:, BUCKETS : BUCKETS + SHAPES] = np.add.reduceat(shape, starts, axis=0)
        for k, lag in enumerate((1, 2, 4)):
            if n > lag:
                x[:, BUCKETS + SHAPES + k] = np.bincount(at[lag:], code[lag:] == code[:-lag], minlength=count)
        x /= np.diff(np.append(starts, n))[:, None]
    x[:, -1] = min(1.0, np.log1p(n) / 10)
    return x


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def score(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of bags that begin at the given rows, and each passage's attention."""
        return _forward(self.parts, (x - self.mean) / self.scale, starts)[:2]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray):
    sizes = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ p["W"] + p["c"])
    v, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (v * g) @ p["u"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return _sigmoid(z @ p["o"] + p["b"][0]), a, h, v, g, z, sizes


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, attention: int = 8, steps: int = 250, seed: int = 7, share: float | None = None) -> Model:
    """Full-batch Adam on the documents' log loss; gradients by hand. With ``share``, that of the ones among all labels, the
    documents are weighted to it, however many of either label were drawn."""
    if not len(bags) or labels.min() == labels.max():
        share = float(labels.mean()) if len(bags) else 0.5
        zero = {"W": (FEATURES, hidden), "c": (hidden,), "V": (hidden, attention), "U": (hidden, attention), "u": (attention,), "o": (hidden,)}
        parts = {k: np.zeros(s) for k, s in zero.items()} | {"b": np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6))])}
        return Model(np.zeros(FEATURES), np.ones(FEATURES), parts)
    drawn = labels.mean()
    share = drawn if share is None else share
    weight = np.where(labels == 1, share / drawn, (1 - share) / (1 - drawn)) / len(labels)
    x = np.concatenate(bags).astype(float)
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    shape = {"W": (FEATURES, hidden), "V": (hidden, attention), "U": (hidden, attention), "u": (attention,), "o": (hidden,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()} | {"c": np.zeros(hidden), "b": np.zeros(1)}
    m, w = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    for t in range(1, steps + 1):
        s, a, h, v, g, z, sizes = _forward(p, x, starts)
        d = (s - labels) * weight
        dz = np.repeat(d[:, None] * p["o"], sizes, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dv, dg = de[:, None] * p["u"] * g * (1 - v**2), de[:, None] * p["u"] * v * g * (1 - g)
        dh = (a[:, None] * dz + dv @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        grad = {"o": z.T @ d, "b": np.array([d.sum()]), "u": (v * g).T @ de, "V": h.T @ dv, "U": h.T @ dg, "W": x.T @ dh, "c": dh.sum(0)}
        for k in p:
            q = grad[k] + (3e-4 * p[k] if k != "b" else 0)
            m[k], w[k] = 0.9 * m[k] + 0.1 * q, 0.99 * w[k] + 0.01 * q**2
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(w[k] / (1 - 0.99**t)) + 1e-8)
    return Model(mean, scale, p)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 3000) -> Model:
    """Fit on a bounded sample of labelled rows, half of either label where there are so many, weighted back to the ratio of
    all labels; the sample's ids (at most ``sample``) are broadcast to the texts."""
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    share = labels.agg(F.avg("label")).first()[0]
    order = [F.xxhash64("id"), F.col("id")]
    picked = labels.where("label = 1").orderBy(*order).limit(sample // 2).union(labels.where("label = 0").orderBy(*order).limit(sample // 2))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in sized(batches):
            bags = [passages(codes, text) for text in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([b.tobytes() for b in bags], pa.binary())], names=["id", "label", "bag"])

    rows = sorted(texts.select("id", "text", "label").mapInArrow(run, "id long, label int, bag binary").collect(), key=lambda r: (r["id"], bytes(r["bag"]), r["label"]))
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["label"] for r in rows], float), share=share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, n_passages, focus (the passage of most attention)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in sized(batches):
            scores, focus, count = [], [], []
            bags = [passages(codes, t) for t in texts_of(batch.column(1))]
            if bags:
                starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
                scores, attention = shared.value.score(np.concatenate(bags), starts)
                count = [len(b) for b in bags]
                focus = [int(np.argmax(attention[s : s + n])) for s, n in zip(starts, count, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(count, pa.int64()), pa.array(focus, pa.int64())], names=["id", "score", "n_passages", "focus"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double, n_passages long, focus long")
