"""Exact kNN from a written index of cells: whole partitions are passed over by the triangle inequality.

Vectors are dealt to the nearest of a few centres and written by centre, with their distance to it. A query that is d away from a
centre is at least |d - r| away from a vector that is r away from it, so once a query has k candidates within a bound, cells, and rows in
cells, whose every vector is farther than the bound are not read. Centres are fitted on at most ``SAMPLE`` vectors; every vector
is indexed, and results equal brute force whatever the centres. How much is passed over depends on the vectors: with clusters most
of it, with independent random vectors of many dimensions nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.vector import BEST, Best, collected, matrix_of, query_blocks, ranked

#: Vectors that centres are fitted on at most, centres at most, and rounds of the fit.
SAMPLE, CELLS, ROUNDS = 20_000, 1024, 8


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))


def centres_of(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Centres by farthest points, then a few rounds of means."""
    centres = vectors[:1]
    near = _distances(vectors, centres)[:, 0] if len(vectors) else np.zeros(0)
    while len(centres) < min(cells, len(vectors)) and near.max() > 0:
        centres = np.vstack((centres, vectors[near.argmax()]))
        near = np.minimum(near, _distances(vectors, centres[-1:])[:, 0])
    for _ in range(ROUNDS if len(centres) > 1 else 0):
        own = _distances(vectors, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, vectors)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def write_cells(index: DataFrame, path: str, id_col: str = "memory_id", vector_col: str = "embedding", cells: int | None = None) -> None:
    """The vectors under ``path``/vectors by cell, and the cells with their centres under ``path``/cells."""
    spark = index.sparkSession
    rows = index.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"].to_pylist()
    sample = np.array(some, float).reshape(len(some), -1 if some else 0)
    centres = centres_of(sample, cells or max(1, min(CELLS, int(len(sample) ** 0.5))))
    shared = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix, centres = matrix_of(batch.column(1), shared.value.shape[1]), shared.value
                own = _distances(matrix, centres).argmin(1)
                r = np.sqrt(((matrix - centres[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "v": batch.column(1), "cell": pa.array(own.astype(np.int32)), "r": pa.array(r)})

    dealt = rows.mapInArrow(deal, "id long, v array<double>, cell int, r double")
    dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("cell", "r").write.partitionBy("cell").parquet(f"{path}/vectors")
    sizes = spark.read.schema("id long, v array<double>, r double, cell int").parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most"))
    named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    sizes.join(F.broadcast(named), "cell").write.parquet(f"{path}/cells")


def _searched(spark: SparkSession, path: str, wanted: np.ndarray, near: np.ndarray, cells: np.ndarray, names: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int) -> DataFrame:
    """The best of the cells that each query wants (a table of queries by cells), within its bound."""
    shared = spark.sparkContext.broadcast((wanted, near, names, vectors, bound, {int(c): i for i, c in enumerate(cells)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, near, names, vectors, bound, at = shared.value
        best = Best(vectors, k, bound)
        for batch in batches:
            own, r, ids = (batch.column(c).to_numpy() for c in ("cell", "r", "id"))
            matrix = matrix_of(batch.column("v"), vectors.shape[1])
            for cell in np.unique(own):
                c, mine = at[int(cell)], np.flatnonzero(own == cell)
                chosen = np.flatnonzero(wanted[:, c])
                # rows that lie within the bound of any of these queries, by their distance to the centre
                low, high = (near[chosen, c] - best.far[chosen]).min(initial=np.inf), (near[chosen, c] + best.far[chosen]).max(initial=-np.inf)
                mine = mine[(r[mine] >= low - 1e-9) & (r[mine] <= high + 1e-9)]
                best.add(ids[mine], matrix[mine], chosen)
        yield best.batch(names)

    read = [int(c) for c, any_ in zip(cells, wanted.any(axis=0), strict=True) if any_]
    rows = spark.read.schema("id long, v array<double>, r double, cell int").parquet(f"{path}/vectors").where(F.col("cell").isin(read))
    return ranked(rows.mapInArrow(run, BEST), k)


def _nearest(spark: SparkSession, path: str, queries: DataFrame, k: int, query_col: str, vector_col: str) -> tuple[DataFrame, int]:
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()  # CELLS rows at most
    names, vectors = collected(queries, query_col, vector_col)
    cells, n, least, most = (table[c].to_numpy() for c in ("cell", "n", "least", "most"))
    if not len(names) or not len(cells):
        return spark.createDataFrame([], f"{BEST}, rank int"), 0
    centres = np.array(table["centre"].to_pylist(), float)
    if vectors.shape[1] != centres.shape[1]:
        raise ValueError(f"query vector has {vectors.shape[1]} dimensions, the index has {centres.shape[1]}")
    near = np.sqrt(((vectors[:, None] - centres) ** 2).sum(2)) if vectors.size * len(centres) < 1 << 24 else _distances(vectors, centres)
    order = np.argsort(near, axis=1)
    first = np.zeros(near.shape, bool)  # the nearest cells that hold k vectors together
    enough = np.cumsum(n[order], axis=1) - n[order] < k
    np.put_along_axis(first, order, enough, axis=1)
    start = _searched(spark, path, first, near, cells, names, vectors, np.full(len(names), np.inf), k)
    held = start.toArrow()  # k rows a query
    place = {x: i for i, x in enumerate(names.tolist())}
    bound, counts = np.zeros(len(names)), np.zeros(len(names), int)
    at = np.array([place[x] for x in held["query"].to_pylist()], int)
    np.maximum.at(bound, at, held["distance"].to_numpy())
    np.add.at(counts, at, 1)
    bound = np.where(counts >= k, bound, np.inf)
    apart = np.maximum(np.maximum(near - most, least - near), 0)
    second = (apart <= bound[:, None] + 1e-9) & ~first
    read = int(n[(first | second).any(axis=0)].sum())
    found = spark.createDataFrame(held) if held.num_rows else spark.createDataFrame([], f"{BEST}, rank int")
    if second.any():
        found = found.unionByName(_searched(spark, path, second, near, cells, names, vectors, bound, k))
    return ranked(found, k), read


def nearest_in_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, query_col: str = "query_id", vector_col: str = "embedding") -> tuple[DataFrame, list[int]]:
    """(query, id, distance, cosine, rank) as ``nearest_many`` gives them, and how many vectors each block of queries read."""
    blocks = [_nearest(spark, path, b, k, query_col, vector_col) for b in query_blocks(queries, query_col)]
    return reduce(DataFrame.unionByName, [b for b, _ in blocks]), [n for _, n in blocks]
