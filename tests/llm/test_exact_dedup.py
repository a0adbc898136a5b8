"""Exact deduplication against a dictionary, over many partitions and odd rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sylvatica.llm import exact_dedup as D
from sylvatica.llm import storage

DROP = str.maketrans("", "", " \t\n\x0b\x0c\r")


def expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault((text or "").translate(DROP), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for plain, members in groups.items():
        keep = min(members)[3]
        sha = hashlib.sha256(plain.encode()).hexdigest()
        out += [(doc, keep, len(members), sha) for *_, doc in members]
    return sorted(out, key=str)


def found(docs, partitions):
    rows = D.mark_duplicates(docs, partitions=partitions).collect()
    kept = [r.digest for r in rows if r.kept]
    assert len(kept) == len(set(map(bytes, kept))) == len({bytes(r.digest) for r in rows})
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in rows), key=str)


ODD = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (None, "a b c"), (None, "abc"), (9, "é x"), (10, "é  x"), (11, "éx"), (12, "y" * 300_000), (13, "A B")]


@pytest.mark.parametrize("partitions", [1, 2, 5, 40])
def test_odd_rows(spark, partitions):
    docs = spark.createDataFrame([(d, t, 1, "r") for d, t in ODD], "doc_id long, text string, run int, digest string").repartition(7)
    assert found(docs, partitions) == expected(ODD)


@pytest.mark.parametrize("partitions", [3, 64])
def test_large_groups_over_many_partitions(spark, partitions):
    rng = random.Random(partitions)
    rows = [(i, rng.choice(["hot text"] * 5 + [f"t {rng.randrange(60)}" + " " * rng.randrange(3)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    assert found(docs, partitions) == expected(rows)


def test_drop_duplicates_keeps_one_row_of_each_group(spark):
    docs = spark.createDataFrame([(d, t, i, "r") for i, (d, t) in enumerate(ODD)], "doc_id long, text string, n long, row string")
    kept = D.drop_duplicates(docs)
    assert kept.columns == docs.columns
    plain = [(r.text or "").translate(DROP) for r in kept.collect()]
    assert sorted(plain) == sorted({(t or "").translate(DROP) for _, t in ODD})
    assert {r.doc_id for r in kept.collect()} >= {12, 13, 6, 3}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.mark_duplicates(docs).count() == 0 and D.drop_duplicates(docs).count() == 0


def test_columns_of_any_name(spark):
    rows = [(1, "a b", 1, 2, 3), (2, "ab", 4, 5, 6), (3, "a  b", 7, 8, 9), (4, "other", 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, Digest long, points long")
    kept = D.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[2], rows[3]]


@pytest.mark.parametrize("most_bits", [4, 27])
def test_rows_that_stay_and_go(spark, monkeypatch, most_bits):
    """Kept once, gone, and untouched rows, with a sieve that tells them apart and one that is full."""
    monkeypatch.setattr(storage, "MOST_BITS", most_bits)
    rng = random.Random(5)
    rows = [(rng.choice((None, *range(200))), f"text {rng.randrange(300)}", i, 1.5) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep long, n double").repartition(4)
    name, raw = storage.identity()
    grouped = docs.groupBy(name.alias("id"), raw.alias("raw"), F.col("doc_id").alias("d"), F.col("text").alias("t")).agg(F.count("*").alias("n"))
    marked = grouped.withColumn("keep", F.coalesce(F.col("d") % 3 != 0, F.lit(True)))
    found = storage.keep_marked(docs, marked.select("id", "raw", "keep", "n"))
    assert found.columns == docs.columns
    kept = [tuple(r)[:2] for r in found.collect()]
    assert sorted(map(str, kept)) == sorted(map(str, {(d, t) for d, t, *_ in rows if d is None or d % 3}))
