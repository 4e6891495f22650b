"""Batched and cell-wise kNN against brute force; near-duplicate scans by their plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import dedup, pivots, vector


def brute(rows, queries, k):
    """{query: [(id, distance)]} by the definition."""
    out = {}
    for name, q in queries:
        far = sorted((float(np.sqrt(((np.array(v) - q) ** 2).sum())), i) for i, v in rows if i is not None and v is not None)
        out[name] = [(i, d) for d, i in far[:k]]
    return out


def clustered(n=400, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 20
    rows = [(i, (centres[i % 12] + rng.normal(size=dims)).tolist()) for i in range(n)]
    return rows + [(n, rows[0][1]), (n + 1, rows[0][1]), (None, rows[0][1]), (n + 2, None)]  # ties, no id, no vector


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["id"], pytest.approx(r["distance"], abs=1e-9)))
    return out


def frames(spark, rows, queries):
    index = spark.createDataFrame(rows, "memory_id long, embedding array<double>").repartition(3)
    return index, spark.createDataFrame([(n, q.tolist()) for n, q in queries], "query_id long, embedding array<double>")


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_batched_search_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(vector, "TILE_ROWS", 16)
    monkeypatch.setattr(vector, "TILE_QUERIES", 3)
    rows = clustered(90)
    queries = [(i, np.array(v)) for i, v in rows[:20:3]] + [(500, np.zeros(6))]
    index, asked = frames(spark, rows, queries)
    assert found(vector.nearest_many(index, asked, k)) == brute(rows, queries, k)
    cosine = {(r["query"], r["id"]): r["cosine"] for r in vector.nearest_many(index, asked, 2).collect()}
    of = dict((i, np.array(v)) for i, v in rows if i is not None and v is not None)
    assert all(c == pytest.approx(float(of[q] @ of[i] / np.linalg.norm(of[q]) / np.linalg.norm(of[i]))) for (q, i), c in cosine.items() if q != 500)
    assert all(c == 0 for (q, _), c in cosine.items() if q == 500)


@pytest.mark.parametrize(("k", "cells"), [(1, 12), (5, 12), (5, 1), (70, 12), (1000, 12)])
def test_cells_equal_brute_force_and_are_passed_over(spark, tmp_path, k, cells):
    rows = clustered()
    queries = [(i, np.array(v) + 0.1) for i, v in rows[:3]] + [(900, np.full(6, 3.0))]
    index, asked = frames(spark, rows, queries)
    path = f"file://{tmp_path}/cells"
    pivots.write_cells(index, path, cells=cells)
    got, read = pivots.nearest_in_cells(spark, path, asked.where("query_id < 900"), k)
    assert found(got) == brute(rows, queries[:3], k)
    assert sum(read) == 402 if cells == 1 or k > 70 else sum(read) <= 402 / (2 if k <= 5 else 1)
    whole, _ = pivots.nearest_in_cells(spark, path, asked, k)
    assert found(whole) == brute(rows, queries, k)


def test_cells_of_odd_tables(spark, tmp_path):
    index, asked = frames(spark, [(1, [0.0, 1.0])] * 3 + [(2, [0.0, 1.0])], [(7, np.array([0.0, 1.0]))])
    pivots.write_cells(index, f"file://{tmp_path}/same")
    got, _ = pivots.nearest_in_cells(spark, f"file://{tmp_path}/same", asked, 2)
    assert [(r["id"], r["distance"]) for r in got.orderBy("rank").collect()] == [(1, 0.0), (1, 0.0)]
    assert pivots.nearest_in_cells(spark, f"file://{tmp_path}/same", asked.limit(0), 2)[0].collect() == []
    with pytest.raises(ValueError, match="dimensions"):
        pivots.nearest_in_cells(spark, f"file://{tmp_path}/same", spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 2)
    pivots.write_cells(index.limit(0), f"file://{tmp_path}/none")
    assert pivots.nearest_in_cells(spark, f"file://{tmp_path}/none", asked, 2)[0].collect() == []


def test_scan_searches_vectors_and_cuts_only_the_texts_of_near_pairs(spark):
    """Results equal brute force, texts are read once a side, and no text is cut into tokens before the joins."""
    rng = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], " ".join(rng.choices(words, k=12)), float(i % 12), None) for i in range(60)]
    rows += [(100 + i, [x + 0.01 for x in v], t + " more", 1.0, None) for i, v, t, *_ in rows[:10]] + [(200, None, "alpha beta", 1.0, None), (201, rows[0][1], "few", 1.0, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, text string, age_days double, superseded_by long")
    allow = spark.createDataFrame([("*", "101"), ("102", "2"), ("x", "y")], "x string, y string")
    got = dedup.nightly_scan(df.drop("text"), df.select("id", "vector"), allow, texts=df.select("id", "text"))
    near = {(r.a, r.b) for r in got.collect()}
    assert {(i, 100 + i) for i in (0, *range(3, 10))} <= near and not {p for p in near if 101 in p} and (2, 102) not in near and not {p for p in near if 201 in p}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("LogicalRDD")
    assert scans <= 4, plan  # vectors found, two texts, the allow-list
    join = min(plan.index(x) for x in ("Join",))
    assert "array_intersect" in plan[:join] or "array_intersect" in plan


def test_allow_list_is_one_join(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.6), (5, 6, 0.7), (7, 8, 0.8)], "a long, b long, cosine double")
    allow = spark.createDataFrame([("2", "1"), ("*", "3"), ("6", "*"), ("9", "8")], "x string, y string")
    kept = dedup.not_allowed(pairs, allow)
    assert [tuple(r) for r in kept.collect()] == [(7, 8, 0.8)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert dedup.not_allowed(pairs, spark.createDataFrame([("*", "*")], "x string, y string")).count() == 0
    assert dedup.not_allowed(pairs, allow.limit(0)).select(F.sum("a")).first()[0] == 16
