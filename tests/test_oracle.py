"""Every registered query with an oracle against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {n: s for n, s in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows):
    def value(x):
        return None if isinstance(x, float) and math.isnan(x) else x

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = oracle.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({SQL[name]}) q")
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["image_i", "image_j", "num_inliers"]


def test_every_oracle_has_a_query():
    assert SQL.keys() <= entry.queries().keys()
