"""Every registered query of the core library against its SQL on DuckDB: rows, column names and types."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sylvatica.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(path := f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(values, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(round(v[i], 6)) if isinstance(v[i], float) else str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, sf_dir, duck, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    sql = catalogue.ORACLES[name]
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    expected = rows(answer.fetchall(), names)
    assert sorted(found.columns) == sorted(names)
    assert expected, "a query without rows proves nothing"
    assert rows([tuple(r) for r in found.collect()], found.columns) == expected
    kinds = dict(duck.execute(f"DESCRIBE {sql}").df()[["column_name", "column_type"]].values)
    assert {c: KINDS.get(k, k) for c, k in found.dtypes} == kinds


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_plans_push_filters_and_prune_columns(spark, sf_dir):
    plan = catalogue.QUERIES["vocab_distinct_pairs"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(p_brand" in plan
    assert "ReadSchema: struct<p_brand:string,p_type:string>" in plan
    best = catalogue.QUERIES["topk_gallery"](spark, sf_dir)._jdf.queryExecution().toString()
    assert best.count("WindowGroupLimit") >= 2  # before and after the exchange


def test_whole_species_join_keeps_every_event_of_a_species(spark, sf_small):
    found = catalogue.QUERIES["obs_species_nullsafe_join"](spark, sf_small)
    seen = duckdb.sql(f"SELECT count(*) FROM '{sf_small}/events.parquet' WHERE user_id IN (SELECT c_custkey FROM '{sf_small}/customer.parquet')").fetchall()[0][0]
    assert found.count() == seen > 0


def test_whole_path_table_keeps_every_line(spark, sf_dir, duck):
    found = catalogue.QUERIES["species_path_table"](spark, sf_dir)
    lines = duck.execute("SELECT count(*) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey % 50 IN (SELECT p_size FROM part)").fetchone()[0]
    assert found.count() == lines > 0
    assert found.select("species_page").distinct().count() > 1
