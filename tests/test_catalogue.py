"""Every query against its SQL on the same tables."""

import os

import duckdb
import pytest

from textloom.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_agrees_with_its_sql(spark, sf_dir, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["split_assignment", "diversity_cap", "stratified_topk", "mix_synthetic"])
def test_partitioning_changes_nothing(spark, sf_dir, name):
    rows = lambda: sorted(map(tuple, QUERIES[name][0](spark, sf_dir).collect()), key=repr)
    before = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert rows() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
