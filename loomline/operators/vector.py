"""Vector search: exact kNN, over-fetched filtered kNN with one escalation, and search of many queries at once.

A vector of another width than the query's is an error, not a miss; rows without a vector are not in the index. The
index is scanned once per block of queries and only the query vectors are broadcast, in blocks of bounded size. Top-k is
a TakeOrdered per query literal; for many queries each task keeps k rows a query, so no pair is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import scores

OVERFETCH, ESCALATED = 5, 25


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def check_width(vector: Sequence[float], width: int) -> None:
    if len(vector) != width:
        raise ValueError(f"query vector has {len(vector)} dimensions, the index has {width}")


def of_width(vector: Column, width: int) -> Column:
    """The vector; an error if it has another width."""
    message = F.concat(F.lit("a vector of the index has "), F.size(vector).cast("string"), F.lit(f" dimensions, the query has {width}"))
    return F.when(F.size(vector) == width, vector).otherwise(F.raise_error(message))


def scored(index: DataFrame, vector: Sequence[float], vector_col: str = "embedding") -> DataFrame:
    """Index rows with distance, similarity (of the distance) and cosine."""
    q = literal(vector)
    v = of_width(F.col(vector_col), len(vector))
    return index.where(F.col(vector_col).isNotNull()).withColumn("distance", scores.l2_distance(v, q)).withColumn("similarity", scores.l2_similarity(F.col("distance"))).withColumn("cosine", scores.cosine(v, q))


def category_filter(include: str | None = None, exclude: Sequence[str] = ()) -> Column:
    """Including drops rows without category, excluding keeps them."""
    keep = F.lit(True)
    if include is not None:
        keep = keep & F.coalesce(F.col("category") == include, F.lit(False))
    if exclude:
        keep = keep & (F.col("category").isNull() | ~F.col("category").isin(list(exclude)))
    return keep


def nearest(index: DataFrame, vector: Sequence[float], k: int, id_col: str = "memory_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows; equal distances go by id."""
    return scored(index, vector, vector_col).orderBy("distance", id_col).limit(k)


def with_sources(hits: DataFrame, sources: DataFrame, id_col: str = "memory_id") -> DataFrame:
    """Hits with what the source table says of them; hits without a source are orphans and go. Hits are few, so they are
    what is broadcast."""
    return sources.join(F.broadcast(hits), id_col)


def nearest_filtered(index: DataFrame, vector: Sequence[float], k: int, keep: Column, factor: int = OVERFETCH, id_col: str = "memory_id", exact: bool = False) -> DataFrame:
    """The first k of the nearest k * factor rows that pass the filter; may be fewer, as the pool is ranked first.

    ``exact`` filters before ranking instead, which is a different answer: k rows whenever k pass.
    """
    if exact:
        return nearest(index.where(keep), vector, k, id_col)
    return nearest(index, vector, k * factor, id_col).where(keep).orderBy("distance", id_col).limit(k)


def nearest_escalated(index: DataFrame, vector: Sequence[float], k: int, keep: Column, id_col: str = "memory_id", factor: int = OVERFETCH, wider: int = ESCALATED) -> DataFrame:
    """As nearest_filtered, but if the narrow pool has fewer than k, rows of the wider pool fill up.

    One plan: the wider pool is ranked once, the narrow pool is its prefix, and a count masks the escalation.
    """
    pool = nearest(index, vector, k * wider, id_col)
    place = Window.orderBy("distance", id_col)
    ranked = pool.withColumn("place", F.row_number().over(place)).where(keep)
    everything = Window.partitionBy(F.lit(1))
    counted = ranked.withColumn("narrow", F.sum((F.col("place") <= k * factor).cast("int")).over(everything))
    chosen = counted.where((F.col("place") <= k * factor) | (F.col("narrow") < k))
    return chosen.orderBy("distance", id_col).limit(k).drop("place", "narrow")


#: Queries that are broadcast at a time, about.
MAX_QUERIES = 10_000


def query_blocks(queries: DataFrame, id_col: str) -> list[DataFrame]:
    """The queries in blocks of about MAX_QUERIES by a hash of the id; the rows of an id stay together."""
    blocks = max(1, -(-queries.count() // MAX_QUERIES))
    return [queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [queries]


def nearest_many(index: DataFrame, queries: DataFrame, k: int, id_col: str = "memory_id", query_col: str = "query_id", vector_col: str = "embedding") -> DataFrame:
    """(query, id, distance, cosine, rank) of every query's k nearest rows; equal distances go by id; queries are broadcast
    block by block."""
    blocks = [_nearest_block(index, b, k, id_col, query_col, vector_col) for b in query_blocks(queries, query_col)]
    return reduce(DataFrame.unionAll, blocks)


#: Rows and queries of one product of matrices.
TILE_ROWS, TILE_QUERIES = 4096, 512


class Best:
    """The k nearest of each query so far, as arrays; all queries and rows of a batch are compared by products of matrices.

    |a - b|^2 = |a|^2 + |b|^2 - 2ab finds who may be among the k nearest, with a margin far above its rounding errors; of those the
    distance is computed as it is defined.
    """

    def __init__(self, vectors: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.vectors, self.k = vectors, k
        self.squares = (vectors**2).sum(axis=1)
        self.far = np.full(len(vectors), np.inf) if bound is None else bound.copy()
        self.query, self.id, self.distance, self.cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def add(self, ids: np.ndarray, matrix: np.ndarray, chosen: np.ndarray | None = None) -> None:
        """Rows to compare with all queries, or with the ``chosen`` ones."""
        chosen = np.arange(len(self.vectors)) if chosen is None else chosen
        for a in range(0, len(ids), TILE_ROWS):
            rows, own = matrix[a : a + TILE_ROWS], ids[a : a + TILE_ROWS]
            squares, found = (rows**2).sum(axis=1), []
            for b in range(0, len(chosen), TILE_QUERIES):
                q = chosen[b : b + TILE_QUERIES]
                near = squares[:, None] + self.squares[q] - 2 * (rows @ self.vectors[q].T)
                limit = self.far[q] ** 2
                if len(rows) > self.k:
                    limit = np.minimum(limit, np.partition(near, self.k - 1, axis=0)[self.k - 1])
                i, j = np.nonzero(near <= limit + 1e-9 * (1 + squares.max() + self.squares[q]))
                found.append((q[j], i))
            self._merge(rows, own, np.sqrt(squares), *map(np.concatenate, zip(*found, strict=True))) if found else None

    def _merge(self, rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray, q: np.ndarray, i: np.ndarray) -> None:
        distance = np.sqrt(((rows[i] - self.vectors[q]) ** 2).sum(axis=1))
        both = lengths[i] * np.sqrt(self.squares[q])
        cosine = np.divide((rows[i] * self.vectors[q]).sum(axis=1), both, out=np.zeros(len(q)), where=both > 0)
        query, id_, distance, cosine = (np.concatenate(x) for x in ((self.query, q), (self.id, ids[i]), (self.distance, distance), (self.cosine, cosine)))
        order = np.lexsort((id_, distance, query))
        starts = np.searchsorted(query[order], np.arange(len(self.vectors)))
        keep = order[np.arange(len(order)) - starts[query[order]] < self.k]
        self.query, self.id, self.distance, self.cosine = query[keep], id_[keep], distance[keep], cosine[keep]
        full = np.bincount(self.query, minlength=len(self.vectors)) == self.k
        worst = np.zeros(len(self.vectors))
        np.maximum.at(worst, self.query, self.distance)
        self.far = np.where(full, np.minimum(self.far, worst), self.far)

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query": pa.array(names[self.query]), "id": pa.array(self.id), "distance": pa.array(self.distance), "cosine": pa.array(self.cosine)})


BEST = "query long, id long, distance double, cosine double"


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    if len(column.flatten()) != len(column) * width:
        raise ValueError(f"a vector of the index does not have the queries' {width} dimensions")
    return column.flatten().to_numpy().reshape(len(column), width)


def collected(queries: DataFrame, query_col: str, vector_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Names and vectors of a block of queries, on the driver to be broadcast."""
    block = queries.select(F.col(query_col).cast("long").alias("query"), F.col(vector_col).cast("array<double>").alias("v")).where("query is not null and v is not null").toArrow()
    names = block["query"].to_numpy()
    return names, np.array(block["v"].to_pylist(), float).reshape(len(names), -1 if len(names) else 0)


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query", "id", "distance", "cosine", "rank")


def _nearest_block(index: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str, vector_col: str) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(collected(queries, query_col, vector_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        best = Best(vectors, k)
        for batch in batches:
            if batch.num_rows and len(names):
                best.add(batch.column(0).to_numpy(), matrix_of(batch.column(1), vectors.shape[1]))
        yield best.batch(names)

    rows = index.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return ranked(rows.mapInArrow(run, BEST), k)
