"""Embedding: what is embedded, by whom, and how an index is filled and kept whole.

An embedder is any object with ``name``, ``width`` and ``embed(texts, query)``; it travels to the executors and works on
Arrow batches. ``HashEmbedder`` needs no model and gives equal vectors everywhere, for tests and for want of a better one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.pack import halve_until
from loomline.sources.commits import scratch

TEXT_CAP, LEAST_CHARS = 4000, 500


class TooLong(ValueError):
    """An embedder's word for an input over its limit."""


class Embedder(Protocol):
    name: str
    width: int

    def embed(self, texts: list[str], query: bool) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Words hashed to signed cells, unit length. ``most`` characters at a time, if set."""

    width: int = 64
    name: str = "hash"
    most: int | None = None

    def embed(self, texts: list[str], query: bool) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        if self.most is not None and len(text) > self.most:
            raise TooLong(f"{len(text)} characters, at most {self.most}")
        cells = [0.0] * self.width
        for word in re.findall(r"[a-z0-9]+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            cells[h % self.width] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(c * c for c in cells))
        return [c / size for c in cells] if size else cells


@dataclass(frozen=True)
class Prefixed:
    """An embedder of a model that wants its inputs marked as query or document."""

    inner: Embedder
    query_mark: str = "search_query: "
    document_mark: str = "search_document: "

    @property
    def name(self) -> str:
        return self.inner.name

    @property
    def width(self) -> int:
        return self.inner.width

    def embed(self, texts: list[str], query: bool) -> list[list[float]]:
        mark = self.query_mark if query else self.document_mark
        return self.inner.embed([mark + t for t in texts], query)


@dataclass
class Resilient:
    """A primary embedder with others behind it.

    A vector of another width than the index never passes. Documents are only embedded by a fallback of the primary's
    name: another model's vectors mean something else, and would stay in the index; a query may take what it gets. After
    ``threshold`` failures in a row the primary is left alone for ``cooldown`` seconds of ``clock``.
    """

    primary: Embedder
    fallbacks: Sequence[Embedder] = ()
    threshold: int = 3
    cooldown: float = 60.0
    clock: object = None
    _state: dict = field(default_factory=lambda: {"fails": 0, "last": 0.0})

    @property
    def name(self) -> str:
        return self.primary.name

    @property
    def width(self) -> int:
        return self.primary.width

    def embed(self, texts: list[str], query: bool) -> list[list[float]]:
        import time

        now, state = (self.clock or time.monotonic)(), self._state
        if state["fails"] >= self.threshold and now - state["last"] >= self.cooldown:
            state["fails"] = 0
        chain = [] if state["fails"] >= self.threshold else [self.primary]
        for one in [*chain, *(f for f in self.fallbacks if query or f.name == self.primary.name)]:
            try:
                vectors = one.embed(texts, query)
                if any(len(v) != self.width for v in vectors):
                    raise ValueError(f"{one.name} gives other than {self.width} dimensions")
            except TooLong:
                raise  # the input's fault, not the embedder's
            except Exception:
                if one is self.primary:
                    state.update(fails=state["fails"] + 1, last=now)
                continue
            if one is self.primary:
                state["fails"] = 0
            return vectors
        raise RuntimeError(f"no embedder gave {self.width}-dimensional vectors")


def chain(models: Sequence) -> object:
    """A text function that tries the models in turn and raises what the last one raised."""

    def call(text: str) -> str:
        error: Exception = RuntimeError("no model")
        for model in models:
            try:
                return model(text)
            except Exception as e:
                error = e
        raise error

    return call


def embed_halving(embedder: Embedder, text: str, query: bool = False, least: int = LEAST_CHARS) -> tuple[list[float], str]:
    """(vector, text that it is of): an input over the embedder's limit is halved until it fits, not below ``least``."""
    return halve_until(lambda t: embedder.embed([t], query)[0], text, lambda e: isinstance(e, TooLong), least)


def embedding_text(description: Column, outcome: Column, steps: Column) -> Column:
    """What of a recipe is embedded: what it is for, how it ended, and its steps' actions; at most 4000 characters."""
    actions = F.transform(steps, lambda s: s["action"])
    parts = F.filter(F.concat(F.array(description, outcome), F.coalesce(actions, F.array().cast("array<string>"))), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.substring(F.trim(F.array_join(parts, "\n")), 1, TEXT_CAP)


def embedded(rows: DataFrame, embedder: Embedder, id_col: str = "memory_id", text_col: str = "text") -> DataFrame:
    """(id, text, embedding): the text that was embedded, cut where the embedder's limit asked for it; embedding is null
    where the embedder failed, so that one failure costs one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, vectors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    vector, kept = embed_halving(embedder, text or "")
                except Exception:
                    vector, kept = None, text
                texts.append(kept)
                vectors.append(vector)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], names=[id_col, text_col, "embedding"])

    slim = rows.select(id_col, F.substring(F.col(text_col), 1, TEXT_CAP).alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, embedding array<double>")


def backfill(memories: DataFrame, index: DataFrame, embedder: Embedder, id_col: str = "memory_id") -> tuple[DataFrame, DataFrame]:
    """(the index with what it lacked, one row of statistics): only memories without a row are embedded, once: what
    they became is written to the shared folder, and both results read it there."""
    missing = memories.join(index.select(id_col), id_col, "left_anti")
    made, place = embedded(missing, embedder, id_col), scratch(memories.sparkSession, "embedded")
    made.write.parquet(place)
    new = memories.sparkSession.read.schema(made.schema).parquet(place).where("embedding is not null")
    more = missing.drop("text").join(new, id_col) if set(missing.columns) > {id_col, "text"} else new
    columns = [c for c in index.columns if c in more.columns]
    filled = index.unionByName(more.select(*columns), allowMissingColumns=True)
    stats = memories.agg(F.count("*").alias("total")).crossJoin(new.join(missing.select(id_col, F.length(F.substring("text", 1, TEXT_CAP)).alias("whole")), id_col).agg(F.count("*").alias("embedded"), F.sum((F.length("text") < F.col("whole")).cast("int")).alias("truncated")))
    known = memories.join(index.select(id_col), id_col, "left_semi").agg(F.count("*").alias("skipped"))
    stats = stats.crossJoin(known).select("total", "embedded", "skipped", (F.col("total") - F.col("embedded") - F.col("skipped")).alias("failed"), F.coalesce("truncated", F.lit(0)).alias("truncated"))
    return filled, stats


def refresh_categories(index: DataFrame, memories: DataFrame, id_col: str = "memory_id") -> DataFrame:
    """The index with categories as the base rows have them; rows without a base row keep theirs."""
    truth = memories.select(id_col, F.col("category").alias("truth"), F.lit(True).alias("known"))
    return index.join(truth, id_col, "left").withColumn("category", F.when(F.col("known"), F.col("truth")).otherwise(F.col("category"))).drop("truth", "known")


def upserted(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """A table after rows were written to it: of each key the last by ``order``, new rows before old ones of equal order."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = F.max_by(F.struct(*[F.col(c) for c in both.columns if c not in (key, "_new")]), F.struct(order, "_new")).alias("x")
    return both.groupBy(key).agg(last).select(key, "x.*")


def trajectories_after(records: DataFrame, new: DataFrame, recalled: DataFrame) -> DataFrame:
    """Recipes after appending new ones and counting recalls (id, ts): recall_count adds up, last_recalled is the latest."""
    counts = recalled.groupBy("id").agg(F.count("*").alias("more"), F.max("ts").alias("latest"))
    every = records.unionByName(new, allowMissingColumns=True)
    return every.join(counts, "id", "left").withColumns({"recall_count": F.coalesce("recall_count", F.lit(0)) + F.coalesce("more", F.lit(0)), "last_recalled": F.greatest("last_recalled", "latest")}).drop("more", "latest")
