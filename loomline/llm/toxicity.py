"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels.

A sentence scores sigmoid(b + sum of the weights of its distinct features); a document scores the leaky noisy-or
1 - (1 - leak) * product(1 - sentence score). Weights, bias and leak are learned from document labels alone through it,
so that the sentences which explain a label get the score; ``sentences`` locates them. The leak is once per document
and explains labels that no sentence does, which the bias, once per sentence, would lay on long documents. A word's
features are the word and its first four, five and six letters, lower-cased, so inflected forms share weight.

Fitting uses a bounded sample: at most ``sample`` labelled rows (half of each label, in an order by hash of the id),
weighted back to the ratio of all labels, with their whole texts. Texts stay in Spark; the driver gets counts of words
and, per row, the sets of chosen features that sentences have. The model has at most ``max_features`` weights, so it is
small enough to broadcast. Scoring runs over whole texts of all rows.

Defined cases: null and empty texts have one empty sentence; without labelled rows of both kinds every score is the
share of label 1 (0 if there are no labels); rows with null label or null id are not learned from; repeated rows are
scored alike; ties among features go by name; an empty table gives no rows; texts of any length are scored whole; other
columns are not returned, whatever their names, unless they are carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import sized

SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")
#: Characters whose lower case depends on what stands around them, or is more than a word's one letter.
ODD_CASE = re.compile("[\u03a3\u0130]")
ODD_SIGN = re.compile(r"[^\w\x00-\x7f]+")
RUN = re.compile(rb"\n+")
#: Bytes of lower-cased text: those of words stay, sentence ends are newlines and all others are spaces.
TOKENS = bytes(10 if chr(b) in ".!?\n" else b if b > 127 or WORD.match(chr(b)) else 32 for b in range(256))


def sentence_words(text: str) -> list[bytes]:
    """The text's sentences, each the lower-cased words in UTF-8 with spaces between."""
    if ODD_CASE.search(text):
        return [" ".join(w.lower() for w in WORD.findall(part)).encode() for part in SENTENCE_END.split(text)]
    low = text.lower()
    return RUN.split((low if low.isascii() else ODD_SIGN.sub(" ", low)).encode().translate(TOKENS))


def word_features(word: str) -> list[str]:
    word = word.lower()
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)]


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    cut: float = 0.5
    leak: float = 0.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gain(a: int, ones: float, b: int, zeros: float) -> float:
    """Log-likelihood ratio of a feature that a of the label-1 and b of the label-0 rows have; 0 if it speaks for 0."""
    if a / ones <= b / zeros:
        return 0.0
    share = (a + b) / (ones + zeros)
    part = lambda seen, expected: seen * np.log(seen / expected) if seen else 0.0
    return 2 * (part(a, ones * share) + part(b, zeros * share) + part(ones - a, ones * (1 - share)) + part(zeros - b, zeros * (1 - share)))


#: Features with less evidence than this stay out, so that rare words of few rows are not learned by heart.
LEAST_GAIN = 12.0


def _counted_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, ones, zeros): rows of each label that have the feature, the empty feature being in every row."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in counts], pa.string()), *(pa.array([n * (y == k) for (_, y), n in counts.items()], pa.int64()) for k in (1, 0))], names=["feature", "ones", "zeros"])

    counts: Counter = Counter()
    for batch in sized(batches):
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts.update((f, y) for f in {"", *(f for w in set(WORD.findall(text.as_py() or "")) for f in word_features(w))})
            if len(counts) > 300_000:
                yield sent(counts)
                counts = Counter()
    if counts:
        yield sent(counts)


def _bag(text: str, number: dict[str, int]) -> list[tuple[tuple[int, ...], int]]:
    """The distinct sets of chosen features that the sentences of a text have, and how many sentences have each."""
    return sorted(Counter(tuple(sorted({number[f] for w in set(WORD.findall(part)) for f in word_features(w) if f in number})) for part in SENTENCE_END.split(text)).items())


def fit(bags: list[tuple[list[tuple[tuple[int, ...], int]], int]], chosen: list[str], share: float, steps: int = 1000, ridge: float = 0.02) -> Model:
    """Weights, bias and leak from (bag, label) rows of both labels by full-batch Adam; ``share`` is that of label 1 in all labels."""
    labels = np.array([y for _, y in bags], float)
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    at, sentence, owner, times = [], [], [], []
    for d, (bag, _) in enumerate(bags):
        for hit, n in bag:
            at += hit
            sentence += [len(owner)] * len(hit)
            owner.append(d)
            times.append(n)
    at, sentence, owner, times = np.array(at, np.int64), np.array(sentence, np.int64), np.array(owner), np.array(times, float)
    theta = np.concatenate((np.zeros(len(chosen)), [-6.0, -6.0]))  # then the bias and the leak's logit
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-2] + np.bincount(sentence, theta[:-2][at], len(owner))
        p = _sigmoid(z)
        clean = np.bincount(owner, -times * np.logaddexp(0, z), len(bags)) - np.logaddexp(0, theta[-1])  # log of the product of 1 - p
        whole = -np.expm1(np.minimum(clean, -1e-12))
        pull = weight * np.where(labels == 1, -np.exp(clean) / whole, 1.0) / len(bags)
        g = p * times * pull[owner]
        leak = float(_sigmoid(theta[-1]))
        grad = np.concatenate((np.bincount(at, g[sentence], len(chosen)) + ridge * theta[:-2] / len(bags), [g.sum(), leak * pull.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(float(theta[-2]), {f: float(w) for f, w in zip(chosen, theta[:-2], strict=True) if abs(w) > 1e-3}, leak=float(_sigmoid(theta[-1])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 4000, max_features: int = 5000) -> Model:
    """Fit on a bounded sample of labelled rows, whose ids (at most ``sample``) are broadcast to the texts."""
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    total = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = total.get(1, 0) / max(sum(total.values()), 1)
    order = [F.xxhash64("id"), F.col("id")]
    picked = labels.where("label = 1").orderBy(*order).limit(sample // 2).union(labels.where("label = 0").orderBy(*order).limit(sample // 2))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "id").select("text", "label", "id")
    counts = rows.select("text", "label").mapInArrow(_counted_features, "feature string, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    counts = counts.where("ones >= 2 or feature = ''").persist()
    whole = counts.where("feature = ''").first()
    if not whole or not whole["ones"] or not whole["zeros"]:
        counts.unpersist()
        return Model(-40.0, leak=share)
    gain = {r["feature"]: g for r in counts.where("feature != ''").toLocalIterator() if (g := _gain(r["ones"], whole["ones"], r["zeros"], whole["zeros"])) >= LEAST_GAIN}
    counts.unpersist()
    chosen = sorted(gain, key=lambda f: (-gain[f], f))[:max_features]
    number = {f: k for k, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            for text, label, at in zip(*batch.columns, strict=True):
                bag = _bag(text.as_py() or "", number)
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], pa.int64()), pa.array([label.as_py()], pa.int32()), pa.array([[list(h) for h, _ in bag]], pa.list_(pa.list_(pa.int32()))), pa.array([[n for _, n in bag]], pa.list_(pa.int64()))], names=["id", "label", "hits", "times"])

    bags = [(r["id"], [(tuple(h), n) for h, n in zip(r["hits"], r["times"], strict=True)], r["label"]) for r in rows.mapInArrow(run, "id long, label int, hits array<array<int>>, times array<long>").toLocalIterator()]
    return fit([(bag, y) for _, bag, y in sorted(bags)], chosen, share)


class _WordWeight(dict):
    """Numbers of a lower-cased word's features with weight; only words that begin as a feature are looked up."""

    def __init__(self, number: dict[str, int]):
        self.number = number
        self.heads = {f.removesuffix("-").encode()[:4] for f in number}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 250_000:
            self.clear()
        found = self[word] = tuple(self.number[f] for f in word_features(word.decode()) if f in self.number)
        return found


class _SentenceLogs(dict):
    """What the log of a text's product of 1 - p gains by a sentence with just these words, and the sentence's score."""

    def __init__(self, words: _WordWeight, model: Model):
        self.words, self.bias, self.empty = words, model.bias, np.logaddexp(0, model.bias)
        self.weights = [model.weights[f] for f in words.number]

    def __missing__(self, hits: frozenset[bytes]) -> tuple[float, float]:
        if len(self) >= 250_000:
            self.clear()
        z = self.bias + sum([self.weights[k] for k in sorted({k for w in hits for k in self.words[w]})])
        found = self[hits] = self.empty - np.logaddexp(0, z), float(_sigmoid(np.array(z)))
        return found


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, _WordWeight({f: k for k, f in enumerate(sorted(model.weights))})
        self.sentences = _SentenceLogs(self.words, model)

    def score(self, text: str) -> tuple[float, list[dict]]:
        """Score of a text, and its sentences that score at least the cut with their character spans."""
        words, model, sentences, heads = self.words, self.model, self.sentences, self.words.heads
        parts = sentence_words(text)
        known = {w for w in set(b" ".join(parts).split(b" ")) if w[:4] in heads and words[w]}
        logs = len(parts) * -sentences.empty
        offending = []
        for k, part in enumerate(parts) if known else ():
            if hits := known.intersection(part.split(b" ")):
                gained, p = sentences[frozenset(hits)]
                logs += gained
                if p >= model.cut:
                    offending.append((k, p))
        ends = [m.start() for m in SENTENCE_END.finditer(text)] if offending else []
        spans = [{"start": ends[k - 1] if k else 0, "end": ends[k] if k < len(ends) else len(text), "score": p} for k, p in offending]
        return float(min(1.0, max(0.0, -np.expm1(logs + np.log1p(-model.leak))))), spans


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row: id, score, sentences (spans of the offending ones with their scores); with ``carry`` the input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sized(batches):
            found = [scorer.score(t or "") for t in batch.column(1).to_pylist()]
            sentences = pa.array([s for _, s in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), sentences, *batch.columns[2:]], names=["id", "score", "sentences", "row"][: 3 + carry])

    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    schema = "id long, score double, sentences array<struct<start:long,end:long,score:double>>"
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    docs = docs.select(*cols)
    return docs.mapInArrow(run, schema + (f", row {docs.schema['row'].dataType.simpleString()}" if carry else ""))
