"""The mix: targets against the sharing carried out step by step, coins against their expectation."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sylvatica.llm import mixing as M


def shares(sizes, weights=(1, 2, 3), cap=3.0):
    """Targets by sharing, capping and sharing the excess again until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped, total = {}, set(), float(sum(sizes.values()))
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        units = sum(weight[s] for s in free)
        target = {s: cap * sizes[s] if s in capped else rest * weight[s] / units for s in order}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice((0, 1, 5, 100, 10_000, rng.randrange(500))) for i in range(rng.randint(1, 9))} | ({None: 40} if seed % 2 else {})
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in M.source_targets(df).collect()}
    assert found == pytest.approx(shares(sizes))


def test_order_of_sources_is_by_code_point_with_null_last(spark):
    df = spark.createDataFrame([(s, 100) for s in ["b", None, "Z", "é", "\U0001f600", "a"]], "source string, source_size long")
    weights = {r.source: r.weight for r in M.source_targets(df).collect()}
    assert weights == {"Z": 1, "a": 2, "b": 3, "é": 1, "\U0001f600": 2, None: 3}


def test_mix_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(40), f"s{i % 3}", "x", 1) for i in range(900)] + [(None, "a b", None, "x", 1), (7, None, None, "x", 1), (7, "   ", "s0", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string, copies int").repartition(5)
    planned = M.with_copies(docs).collect()
    for r in planned:
        assert 0 <= r.copies <= 3 and r.copies in (int(r.rate), int(r.rate) + 1)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert {r.source: r.source_size for r in planned} == sizes
    for source in ("s0", "s1", "s2"):
        taken, target = sum(r.copies * r.size for r in planned if r.source == source), next(r.target for r in planned if r.source == source)
        assert abs(taken - target) < 0.12 * target
    emitted = M.mix_documents(docs)
    assert emitted.columns == docs.columns
    counts = {(r.doc_id, r.text, r.source): r["count"] for r in emitted.groupBy("doc_id", "text", "source").count().collect()}
    assert counts == {k: n for k, n in {(r[0], r[1], r[2]): next(p.copies for p in planned if (p.doc_id, p.source) == (r[0], r[2]) and p.size == len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows}.items() if n}


def test_reruns_agree_and_salted_join_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a " * (i % 9), f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    first = sorted(map(tuple, M.with_copies(docs).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    cut = M.with_copies(docs.repartition(9))
    assert sorted(map(tuple, cut.select(*M.with_copies(docs).columns).collect())) == first


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.with_copies(docs).count() == 0 and M.mix_documents(docs).count() == 0


def test_coin_is_uniform(spark):
    coins = spark.range(20_000).select(M.coin("id").alias("c")).agg(F.avg("c").alias("m"), F.min("c").alias("l"), F.max("c").alias("h")).first()
    assert abs(coins.m - 0.5) < 0.01 and 0 <= coins.l < 0.01 and 0.99 < coins.h < 1


def test_columns_of_any_name_and_null_ids(spark):
    rows = [(None, f"word {i} of it", "a" if i % 3 else "b", i, i, i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long, source_rate long, salt long").repartition(4)
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    taken = {r.source: r.n * 4 for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    targets = {r.source: r.target for r in M.with_copies(docs).select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - targets[s]) < 0.05 * targets[s] for s in targets)


def test_many_sources(spark):
    """Thousands of sources, numbered and summed in ranges."""
    rng = random.Random(3)
    sizes = {f"s{i:05}": rng.choice((1, 5, 50, 500, 5000)) for i in range(4000)} | {None: 70}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(6)
    found = {r.source: (r.target, r.weight) for r in M.source_targets(df).collect()}
    assert {s: t for s, (t, _) in found.items()} == pytest.approx(shares(sizes))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [found[s][1] for s in order] == [1 + i % 3 for i in range(len(order))]


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(3000)]
    found = M.running(spark.createDataFrame(rows, "i long, k long, v long").repartition(5), [F.col("k"), F.col("i")], ["v"]).collect()
    total = 0
    for place, (i, k, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        row = next(r for r in found if r.i == i) if place % 500 == 1 else None
        assert row is None or (row.place, row.before_v) == (place, total)
        total += v
    assert sorted(r.place for r in found) == list(range(1, 3001))
