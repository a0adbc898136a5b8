"""The vector-approximation search against all inner products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvatica.llm import topk_search as T


def brute(rows, k=10):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for q, a in usable:
        if q % 100 == 0 and q not in seen:
            seen.add(q)
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in usable if i != q and len(b) == len(a))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "rank": F.lit(2)}).repartition(5)
    vectors = T.usable(df)
    return sorted(map(tuple, T.search(vectors, vectors.where("id % 100 = 0"), **options).collect()))


@pytest.mark.parametrize("query_bytes", [8 << 20, 500])
def test_against_all_products(spark, query_bytes, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BYTES", query_bytes)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    assert search(spark, rows) == brute(rows)
    assert search(spark, rows, bits=3, k=3) == brute(rows, 3)


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(95, 130)]
    rows += [(200, None), (300, []), (301, []), (302, []), (400, [1.0, None, 0.0, 0.0]), (500, [float("nan"), 0.0, 0.0, 0.0]), (600, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (700, [0.5, 0.25]), (701, [1.0, -1.0]),
             (800, [0.0, 0.0, 0.0, 0.0]), (131, rows[3][1]), (900, [1.0, 2.0, 3.0])]
    assert search(spark, rows) == brute(rows)
    rows += [(132, rows[3][1])] * 3 + [(100, rows[5][1])]
    found = search(spark, rows)
    assert [(q, r) for q, r, *_ in found] == [(q, r) for q, r, *_ in sorted(brute(rows))]
    assert all(q != i for q, _, i, _ in found)


def test_very_large_components_are_exact(spark):
    rows = [(i, [float(i) * 1e4, -1e5, 3e3 * i]) for i in range(0, 130, 5)]
    assert search(spark, rows) == brute(rows)
    rows = [(i, [float(i) * 1e9, -1e10, 3e8]) for i in range(0, 130, 5)]
    assert search(spark, rows) == brute(rows)


def test_fewer_candidates_than_k_and_empty_table(spark):
    assert search(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 1024 * 2048)]
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, []) == []


def test_few_vectors_are_read_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=32) / 6]) for i in range(4000)]
    rows[17] = (17, [1e4] * 32)  # one vector of another size does not widen the others' cells
    vectors = T.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    asked = vectors.where("id % 100 = 0")
    left = T.candidates(T.distinct_vectors(vectors, 10), asked, 10)
    assert 400 <= left.count() < 40 * 4000 * 0.02
    assert search(spark, rows) == brute(rows)


@pytest.mark.parametrize("first", [1, 3])
def test_a_first_scan_bounds_what_tasks_write(spark, first, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(3000)]
    vectors = T.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(40))
    asked = vectors.where("id % 100 = 0")
    distinct = T.distinct_vectors(vectors, 10).repartition(40)
    cells = T.settle(distinct.mapInArrow(T._approximate(8), T.CELLS), "cells")
    known = asked.collect()
    sent = spark.sparkContext.broadcast({8: (np.array([r["id"] for r in known]), np.array([r["v"] for r in known], float))})
    without = cells.mapInArrow(T._scan(sent, 10, 8), T.BOUNDS).count()
    monkeypatch.setattr(T, "FIRST", first)
    floors = spark.sparkContext.broadcast(T._floors(cells, sent, 10, 8))
    assert np.isfinite(floors.value[8]).all()
    assert cells.mapInArrow(T._scan(sent, 10, 8, floors), T.BOUNDS).count() < without / 2
    assert search(spark, rows) == brute(rows)


def test_repeated_vectors_are_searched_once(spark):
    rng = np.random.default_rng(2)
    hot = [0.5] * 8
    rows = [(i, hot) for i in range(3000)] + [(3000 + i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(100, hot)] * 25
    vectors = T.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    assert T.distinct_vectors(vectors, 10).count() == 20 + 300
    assert search(spark, rows) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e3, 1e9, 4e18):
        vectors = np.floor(rng.uniform(-1, 1, (300, 24)) * scale).astype(np.int64)
        queries = vectors[:40].astype(float)
        for bits in (1, 4, 8):
            grid = T.Grid.of(vectors, bits)
            score, reach = grid.scores(grid.cells(vectors, bits), queries)
            exact = vectors[:40].astype(object) @ vectors.T.astype(object)
            for q in range(40):
                assert all(float(score[q, v]) - reach[q] <= exact[q, v] <= float(score[q, v]) + reach[q] for v in range(300))
