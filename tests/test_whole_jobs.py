"""Queries take all that their names say, on small tables made for it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.plans.catalogue import QUERIES


def test_filter_head_takes_a_hundred(spark, tmp_path):
    docs = [(d, "abcdefg\nit is in six or so words") for d in range(150)]
    spark.createDataFrame([(d, t, "en", "x") for d, t in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["filter_pipeline"][0](spark, str(tmp_path)).count() == 150
    found = [r.pair_id for r in QUERIES["filter_head"][0](spark, str(tmp_path)).collect()]
    assert sorted(found) == [d * 1_000_000 for d in range(100)]


def test_a_customer_with_any_order_is_not_idle(spark, tmp_path):
    spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(2, "O", "5-LOW"), (3, "P", "1-URGENT")], "o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in QUERIES["ext_idle_customers"][0](spark, str(tmp_path)).collect()] == [("A", 1)]


@pytest.mark.parametrize("name", ["hq_sample_full", "hq_sample_diverse"])
def test_samples_of_more_pairs_than_the_target(spark, tmp_path, name):
    """356,400 good pairs of several strata, so that what the sampler leaves out is not nothing."""
    text = F.lit("\n".join(f"{'x' * (3 + i % 9)}\n{' '.join('y' * (3 + i // 9 % 9))}" for i in range(400)))
    spark.range(2200).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = QUERIES[name]
    df = query(spark, str(tmp_path))
    df.write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(f"CREATE TABLE want AS SELECT {', '.join(df.columns)} FROM ({sql})")
    con.execute(f"CREATE TABLE got AS SELECT {', '.join(df.columns)} FROM '{tmp_path}/out/*.parquet'")
    count = lambda q: con.execute(f"SELECT count(*) FROM ({q})").fetchone()[0]
    assert count("FROM want EXCEPT ALL FROM got") == 0 and count("FROM got") == count("FROM want") > 100_000
