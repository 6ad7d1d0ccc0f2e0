"""Streams over files give what the batch operators give."""

from pyspark.sql import functions as F

from textloom.operators import cleaning, filtering
from textloom.sources.adapters import pairs_lines
from textloom.streaming import corpus


def lines(spark, sf_dir, path):
    pairs = pairs_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pairs.select(F.col("src").alias("chinese"), F.col("tgt").alias("english"), "source").repartition(6).write.json(path)
    return pairs


def test_clean_stream_is_the_batch(spark, sf_dir, tmp_path):
    pairs = lines(spark, sf_dir, str(tmp_path / "in"))
    corpus.run_available(corpus.clean(corpus.read_pairs(spark, str(tmp_path / "in"), 2)), str(tmp_path / "out"), str(tmp_path / "point"))
    got = sorted((r.src.strip(), r.tgt.strip()) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.src.strip(), r.tgt.strip()) for r in cleaning.clean(pairs).collect()) and len(got) > 100


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "chinese string, english string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run = lambda: corpus.run_available(corpus.clean(corpus.read_pairs(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "point"))
    put([("aaaaa", "b" * 12)])
    run()
    put([("aaaaa", "b" * 12), ("ccccc", "d" * 12)])
    run()
    assert sorted(r.src for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["aaaaa", "ccccc"]


def test_filter_stream_with_statistics(spark, sf_dir, tmp_path):
    pairs = lines(spark, sf_dir, str(tmp_path / "in"))
    stream = corpus.filtered(corpus.read_pairs(spark, str(tmp_path / "in"), 2))
    stats = lambda b: b.agg(F.count("*").alias("n"))
    corpus.with_batch_stats(stream, str(tmp_path / "out"), str(tmp_path / "point"), stats, str(tmp_path / "stats")).awaitTermination()
    n = spark.read.json(str(tmp_path / "stats")).agg(F.sum("n")).first()[0]
    assert n == filtering.filter_pipeline(pairs).count() > 0


def test_late_rows_are_left_out(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    put = lambda *rows: spark.createDataFrame([(t, "a", v) for t, v in rows], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = corpus.rolling_stats(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), window="1 hour", late="10 minutes")
        corpus.run_available(stream, str(tmp_path / "out"), str(tmp_path / "point"))

    put(("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:20:00", 3.0), ("2024-01-01 03:00:00", 9.0))
    run()
    put(("2024-01-01 00:30:00", 100.0), ("2024-01-01 05:00:00", 1.0))
    run()
    found = sorted((str(r.start), r.n, r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [("2024-01-01 00:00:00", 2, 2.0), ("2024-01-01 03:00:00", 1, 9.0)]
