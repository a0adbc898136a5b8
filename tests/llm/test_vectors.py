"""Codes, learned partitions and whitening of vectors against plain readings of what they are."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvatica.llm import learned_partitions as L
from sylvatica.llm import registry, vector_codes as C, whitening as W


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumns({"code": F.lit("x"), "v": F.lit(1), "row": F.lit(2), "size": F.lit(3), "part": F.lit(4), "error": F.lit(5)}).repartition(5)


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def some(n, size, seed=1, first=0, scale=0.3):
    rng = np.random.default_rng(seed)
    return [(first + i, [float(np.float32(x)) for x in rng.normal(size=size) * scale], i % 3 if i % 7 else None) for i in range(n)]


ODD = [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1)]


# --- codes -----------------------------------------------------------------------------------------------------


def plain_codes(rows):
    kept = sorted(([math.floor(4096 * x) for x in v], i, label) for i, v, label in rows if finite(v))
    kept.sort(key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    size = len(kept[0][0]) if kept else 0
    parts = [[tuple(r[0][size * p // 8 : size * (p + 1) // 8]) for p in range(8)] for r in kept]
    books = [[row[p] for row in parts[:16]] for p in range(8)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(6):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for row in parts:
                own[near(row[p], book)[1]].append(row[p])
            books[p] = [tuple(sum(c) // len(own[i]) for c in zip(*own[i], strict=True)) if own[i] else e for i, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[near(row[p], books[p]) for p in range(8)] for row in parts]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for e, r in zip(errors, kept, strict=True):
        by_label[r[2]] += e
    return sorted((repr(r[1]), "".join(f"{i:02x}" for _, i in f), min(e, 2**63 - 1), min(by_label[r[2]], 2**63 - 1), digest) for r, f, e in zip(kept, found, errors, strict=True))


def codes(spark, rows, **options):
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in C.quantise(frame(spark, rows, **options)).collect())


def test_codes_against_plain_rounds(spark):
    rows = some(300, 16) + ODD
    assert codes(spark, rows) == plain_codes(rows)


def test_codes_of_ties_repeats_and_missing_ids(spark):
    rows = [(i // 2, [0.25 * (i % 4), 0.0] * 8, i % 2) for i in range(60)] + [(None, [1.0] * 16, None)] * 3 + [(5, [0.25] * 16, 1)] * 40
    assert codes(spark, rows) == plain_codes(rows)


def test_codes_of_few_rows_large_components_and_odd_lengths(spark):
    assert codes(spark, some(5, 16)) == plain_codes(some(5, 16))
    large = [(i, [x * 1e14 for x in v], c) for i, v, c in some(40, 16)]
    assert codes(spark, large, kind="double") == plain_codes(large)
    assert codes(spark, some(40, 11)) == plain_codes(some(40, 11))
    assert codes(spark, ODD) == codes(spark, []) == []
    mixed = [r for r in codes(spark, some(40, 16) + [(2000, [], 9), (2001, [0.5] * 3, 9)]) if r[0] in ("2000", "2001")]
    assert [r[1] for r in mixed] == ["00" * 8] * 2 and [r[2] for r in mixed] == [0, 0]


def test_an_annulus_holds_every_nearest_entry():
    rng = np.random.default_rng(2)
    entries = np.vstack((rng.integers(-50, 50, (12, 3)), [[3, 4, 0], [4, 3, 0], [0, 0, 5], [0, 0, 0]]))
    parts = np.vstack((rng.integers(-60, 60, (400, 3)), entries))
    for scale in (1, 2**55):
        table = C.Annuli(entries * scale)
        index, best = table.nearest(parts * scale)
        plain = ((parts[:, None].astype(object) - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == [row.argmin() for row in plain]
        assert [int(b) for b in best] == [int(row.min()) * scale**2 for row in plain]
    spread = np.arange(16)[:, None] * np.full((1, 4), 1000)  # norms far apart: few entries are measured
    table = C.Annuli(spread)
    table.nearest(spread[rng.integers(0, 16, 500)] + rng.integers(-50, 50, (500, 4)))
    assert table.measured < 500 * 3


def test_codes_query_against_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    expected = con.execute(registry.ORACLES["op11_annular_codes"]).fetchall()
    found = registry.QUERIES["op11_annular_codes"](spark, sf_dir).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len(expected) == 500


# --- learned partitions ----------------------------------------------------------------------------------------


def plain_nearest(rows, k=10):
    usable = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and finite(v) and any(v)]
    out = {}
    for q, a in sorted(usable, key=lambda r: (r[0], r[1].tolist()), reverse=True):
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in usable if i != q and len(a) == len(b))
            out[q] = near[:k]
    return {q: near for q, near in out.items() if near}


def found_nearest(spark, rows, k=10, **options):
    vectors = L.usable(frame(spark, rows))
    out = defaultdict(list)
    for r in L.search(vectors, vectors.where("id % 100 = 0"), k, **options).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def same(found, expected):
    assert found.keys() == expected.keys()
    for q, near in expected.items():
        assert [i for _, i in found[q]] == [i for _, i in near]
        assert np.allclose([s for s, _ in found[q]], [s for s, _ in near], rtol=1e-14, atol=0)


def test_one_part_is_exact(spark):
    rows = some(120, 8) + [(None, [1.0] * 8, 1), (400, [0.0] * 8, 1), (500, [0.5, 0.25], 1), (501, [1.0, -1.0], 1), (600, [], 1)] + [(i, [1.0] * 8, 1) for i in (700, 701, 702)] + ODD
    same(found_nearest(spark, rows), plain_nearest(rows))
    assert found_nearest(spark, []) == {} and found_nearest(spark, [(0, [1.0], 1)]) == {}
    assert found_nearest(spark, [(0, [1.0], 1), (3, [3.0], 1)]) == {0: [(2.0, 3)]}


def test_repeats_take_ranks_and_a_query_is_answered_once(spark):
    rows = some(60, 4) + [(7, [0.5] * 4, 1)] * 4 + [(100, [0.5] * 4, 1), (100, [0.25] * 4, 1)]
    found = found_nearest(spark, rows)
    assert [len(v) for v in found.values()] == [10, 10]
    same(found, plain_nearest(rows))


def test_all_parts_are_exact_and_recall_is_as_asked(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAST_ROWS", 50)  # many shards
    monkeypatch.setattr(L, "SHARD_BYTES", 8 * 16 * 7)  # of queries too
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=16) * 0.3], 1) for i in range(1500)]
    rows += [(2000 + i, rows[3][1], 1) for i in range(700)]  # a hot vector
    expected = plain_nearest(rows)
    same(found_nearest(spark, rows, target=1.1), expected)  # more than can be: all parts
    found = found_nearest(spark, rows)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in near}) for q, near in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_an_index_holds_every_row_and_routes_to_few_parts(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12)) * 3
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=12) * 0.3], 1) for i in range(2400)]
    vectors = L.usable(frame(spark, rows))
    index = L.build(vectors, 12)
    assert sum(index.counts.values()) == index.rows.select("id").distinct().count() == 2400
    assert len(index.counts) > 8 and index.probes <= len(index.counts) / 2 and index.recall >= L.TARGET


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(6)
    group = np.repeat(np.arange(8), 50)
    edges = np.array([(i, j) for i in range(400) for j in rng.choice(np.flatnonzero(group == group[i]), 5) if i != j])
    parts = L.balanced_parts(400, edges, 3)
    assert np.bincount(parts).tolist() == [50] * 8
    assert (parts[edges[:, 0]] == parts[edges[:, 1]]).mean() > 0.9
    assert np.bincount(L.balanced_parts(11, edges[:0], 2), minlength=4).max() == 3


def test_learned_query_reaches_its_recall(spark, sf_dir):
    found = defaultdict(set)
    for r in registry.QUERIES["op12_learned_partitions"](spark, sf_dir).collect():
        found[r["query_id"]].add(r["vec_id"])
    rows = [(r["vec_id"], r["embedding"], 1) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = plain_nearest(rows)
    hits = sum(len(found[q] & {i for _, i in near}) for q, near in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values())) and all(len(v) == 10 for v in found.values())


# --- whitening -------------------------------------------------------------------------------------------------


def check_whitened(spark, rows, rank, **options):
    kept = [(i, [min(2**53, max(-(2**53), math.floor(64 * x))) + 1_000_000 for x in v]) for i, v, _ in rows if finite(v)]
    n, size = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(size)]
    apart = np.array([[(n * x[j] - sums[j]) / n for j in range(size)] for _, x in kept])
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    found = W.whiten(frame(spark, rows, **options)).collect()
    assert len(found) == n * rank
    assert {r["n"] for r in found} == {n} and all(r["identity_error"] < 1e-9 for r in found)
    by_row = defaultdict(list)
    for r in found:
        by_row[repr(r["vec_id"])].append(r)
    deviations = defaultdict(list)
    for i, x in kept:
        deviations[repr(i)] += [min(2**63 - 1, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))] * rank
    assert {i: sorted(r["deviation"] for r in rs) for i, rs in by_row.items()} == {i: sorted(d) for i, d in deviations.items()}
    explained = {r["component"]: r["explained"] for r in found}
    assert np.allclose([explained[c] for c in range(1, rank + 1)], values / (apart**2).sum() * n, rtol=1e-9)
    if len(by_row) == n:
        made = np.array([[r["whitened"] for r in sorted(by_row[repr(i)], key=lambda r: r["component"])] for i, _ in kept])
        plain = apart @ vectors / np.sqrt(values)
        assert np.allclose(made * np.sign((made * plain).sum(axis=0)), plain, atol=1e-8)


def test_whitening_against_all_eigenvectors(spark):
    check_whitened(spark, some(200, 16) + ODD, 16)
    check_whitened(spark, some(300, 40), 32)


def test_whitening_of_repeats_low_rank_and_large_components(spark):
    check_whitened(spark, some(50, 16) + [(7, [0.5] * 16, 1)] * 30 + [(None, [1.0] * 16, None)], 16)
    check_whitened(spark, some(6, 16), 5)  # fewer rows than dimensions
    check_whitened(spark, [(i, [x * 1e6 for x in v], 1) for i, v, _ in some(60, 4)], 4, kind="double")
    assert W.whiten(frame(spark, [(1, [1.0, 2.0], 1)] * 4)).count() == 0  # no spread
    assert W.whiten(frame(spark, ODD + [(1, [], 1)])).count() == W.whiten(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [512, 70])
def test_block_lanczos_finds_close_and_equal_eigenvalues(most):
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.normal(size=(150, 150)))[0]
    values = np.concatenate((np.full(6, 9.0), 8.0 - np.arange(60) * 1e-3, np.full(30, 1.0), np.zeros(54)))
    passes = []

    def multiply(q):
        passes.append(q.shape[1])
        return turn @ (values[:, None] * (turn.T @ q))

    found, vectors = W.block_lanczos(multiply, 150, 32, block=8, most=most)
    assert np.allclose(found, values[:32], atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(32), atol=1e-12)
    assert np.allclose(turn @ (values[:, None] * (turn.T @ vectors)), vectors * found, atol=1e-11)
    zero, _ = W.block_lanczos(lambda q: np.zeros_like(q), 20, 8)
    assert np.allclose(zero, 0)


def test_whitening_query_against_all_eigenvectors(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], 1) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitened(spark, rows, 32)
    assert registry.QUERIES["op13_lanczos_whitening"](spark, sf_dir).count() == 32 * len(rows)
