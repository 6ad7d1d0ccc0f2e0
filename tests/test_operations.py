"""Languages, intervals, functions of SQL, term lookups and the running curriculum against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.config import load_rules
from textloom.functions import registry
from textloom.operators import language, lookup, relational, sampling, splits
from textloom.operators.cleaning import CleaningRules
from textloom.plans import operations
from textloom.sources import readers, writers
from textloom.streaming import curriculum


def test_languages_of_held_out_texts(spark):
    """On more texts than the smallest tables have."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = operations.held_out()
    found = language.score(docs.filter(held), language.train(docs.filter(~held))).join(docs.select("doc_id", "lang"), "doc_id")
    n, right = found.agg(F.count("*"), F.count_if(F.col("language") == F.col("lang"))).first()
    assert n > 100 and right / n > 0.95


def test_languages_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "unlabelled", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    texts = spark.createDataFrame([(1, "The DOG"), (2, "und"), (3, None), (4, " 12 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.language, r.grams) for r in language.score(texts, model).collect()}
    assert got == {1: ("en", 6), 2: ("de", 3), 3: (None, 0), 4: (None, 0), 5: (None, 0)}
    assert language.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("by", [[], ["k"]])
def test_interval_join(spark, by):
    rng = random.Random(len(by))

    def rows(n):
        out = []
        for i in range(n):
            a = rng.randrange(-3000, 3000)
            out.append((i, rng.choice([1, 1, 1, 2, None]), a, a + rng.choice([0, 0, 1, 5, 300, 2500, -4])))
        return out + [(n, 1, None, 5), (n + 1, 1, 5, None), (n + 2, 1, -(1 << 40), 1 << 40)]

    left, right = rows(120), rows(140)
    a, b = (spark.createDataFrame(x, "id long, k long, s long, e long") for x in (left, right))
    got = sorted((r.l.id, r.r.id) for r in relational.interval_join(a, b, "s", "e", by).collect())
    good = lambda r: r[2] is not None and r[3] is not None and r[2] <= r[3] and (not by or r[1] is not None)
    want = sorted((x[0], y[0]) for x in left for y in right if good(x) and good(y) and x[2] <= y[3] and y[2] <= x[3] and (not by or x[1] == y[1]))
    assert got == want
    plan = relational.interval_join(a, b, "s", "e", by)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_terms_of_all_kinds(spark):
    terms = spark.createDataFrame([(1, "ab", "xyz"), (1, "ab", "other"), (2, "b", None), (3, "", "never"), (4, None, "é你"), (5, None, None)], "term_id long, source string, target string")
    texts = [(1, "cab"), (2, "é你好"), (3, None), (4, ""), (5, "xyz other " * 3)]
    got = sorted((r.id, r.term_id, r.term_source, r.term_target) for r in lookup.match_terms(spark.createDataFrame(texts, "id long, text string"), terms).select("id", "term_id", F.coalesce("term_source", F.lit("-")).alias("term_source"), F.coalesce("term_target", F.lit("-")).alias("term_target")).collect())
    has = lambda text, name: name is not None and name in text
    want = sorted((i, k, s if s is not None else "-", t if t is not None else "-") for i, text in texts if text is not None for k, s, t in [tuple(r) for r in terms.collect()] if has(text, s) or has(text, t))
    assert got == want
    assert lookup.match_terms(spark.createDataFrame(texts, "id long, text string"), terms.limit(0)).collect() == []


def test_a_large_glossary_is_one_scan(spark):
    terms = spark.range(200_000).selectExpr("id AS term_id", "concat('term', id, 'q') AS source", "concat('ziel', id, 'q') AS target")
    texts = spark.createDataFrame([(1, "term7q and ziel199999q"), (2, "nothing here")], "id long, text string")
    found = lookup.match_terms(texts, terms)
    assert sorted((r.id, r.term_id) for r in found.collect()) == [(1, 7), (1, 199999)]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_functions_follow_the_rules(spark):
    names = registry.register(spark, CleaningRules(min_src=2, max_src=3), bounds=(1, 2))
    assert {"reject_reason", "pack_batches", "entropy_of_counts"} <= set(names)
    assert [r.x for r in spark.sql("SELECT reject_reason(s, 'twelve chars') AS x FROM VALUES ('a'), ('abc'), ('abcd'), (' '), (null) t(s)").collect()] == ["zh_length", "valid", "zh_length", "empty", "empty"]
    assert spark.sql("SELECT length_bucket(1), length_bucket(2), length_bucket(9)").first() == (0, 1, 2)
    registry.register(spark)


def test_packing(spark):
    registry.register(spark)
    spark.createDataFrame([(b, 0, i, n) for b in (1, 2) for i, n in enumerate([4, 5, 3, 20, 1, None, 9])], "bucket int, shard int, id int, n int").createOrReplaceTempView("__t")
    got = sorted(tuple(r) for r in spark.sql("SELECT bucket, id, batch FROM pack_batches(TABLE(__t), 10)").collect())
    assert got == [(b, i, k) for b in (1, 2) for i, k in enumerate([0, 0, 1, 2, 3, 3, 3])]
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM pack_batches(TABLE(SELECT 1 AS id), 10)").collect()


def test_entropy(spark):
    registry.register(spark)
    assert spark.sql("SELECT entropy_of_counts(n) AS h FROM VALUES (1), (1), (2), (0), (null) t(n)").first().h == pytest.approx(1.5)


def test_running_losses_go_on_after_a_restart(spark, tmp_path):
    files, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    schema = "difficulty string, loss double"
    for k in range(3):
        spark.createDataFrame([("easy", 0.5 + k), ("hard", 2.0), (None, 1.0), ("easy", None)], schema).write.mode("append").parquet(files)
        stream = curriculum.running_losses(spark.readStream.schema(schema).parquet(files))
        query = stream.writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).option("checkpointLocation", point).outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(tuple(r) for r in curriculum.latest(spark.read.parquet(out)).collect())
    assert got == sorted(tuple(r) for r in curriculum.totals(spark.read.parquet(files)).collect()) == [("easy", 3, 4_500_000), ("hard", 3, 6_000_000)]


def test_refill(spark):
    rows = spark.createDataFrame([(i, 0.8 if i < 90 else 0.9) for i in range(100)], "pair_id long, similarity_score double")
    assert sampling.bucket_capped(rows).count() == 60
    assert sampling.bucket_capped(rows, refill=80).count() == 80
    assert sampling.bucket_capped(rows, refill=50).count() == 60
    assert sampling.bucket_capped(rows, refill=101).count() == 60


def test_report_with_a_byte_order_mark(spark, tmp_path):
    writers.write_csv_report(spark.createDataFrame([("é", 1)], "name string, n int"), str(tmp_path / "r"), mark=True)
    [part] = (tmp_path / "r").glob("part-*.csv")
    assert part.read_text(encoding="utf-8-sig") == "name,n\né,1\n"


def test_sampled_rows_are_the_same_for_every_partitioning(spark):
    rows = spark.range(500).withColumnRenamed("id", "key")
    some = [sorted(r.key for r in readers.sampled(rows.repartition(p), 50, "key").collect()) for p in (1, 7)]
    assert some[0] == some[1] and len(some[0]) == 50


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('\ufeff{"cleaning": {"max_src": 99, "check_language": true, "min_ratio": 0}, "sampling": {}}', encoding="utf-8")
    rules = load_rules(spark, str(path))
    assert (rules["cleaning"].max_src, rules["cleaning"].check_language, rules["cleaning"].min_ratio) == (99, True, 0.0)
    assert rules["cleaning"].min_src == CleaningRules().min_src and rules["filtering"].max_ratio == 0.5 and rules["sampling"].target == 300_000
    for bad, says in (('{"other": {}}', "sections"), ('{"cleaning": {"least": 1}}', "cleaning.least"), ('{"cleaning": {"max_src": "9"}}', "kind"), ('{"cleaning": {"check_language": 1}}', "kind"), ("[]", "sections")):
        path.write_text(bad)
        with pytest.raises(ValueError, match=says):
            load_rules(spark, str(path))


def test_batches_in_the_order_of_an_epoch(spark):
    rows = spark.createDataFrame([(b, k) for b in range(3) for k in range(40) for _ in range(2)], "bucket int, batch_id long")
    orders = [[(r.bucket, r.batch_id) for r in splits.batch_positions(rows, "bucket", "batch_id", epoch=e).orderBy("position").collect()] for e in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == sorted(orders[2]) == [(b, k) for b in range(3) for k in range(40)]


def test_interval_join_shuffles_what_is_used(spark):
    """Of long rows only keys, ends and what is asked for come to the join; visitors of a cell don't meet each other; the join is by equality at any size."""
    rows = spark.range(400).selectExpr("id", "id * 10 AS s", "id * 10 + CASE WHEN id % 100 = 0 THEN 3000 ELSE 4 END AS e", "repeat('x', 1000) AS note")
    met = relational.interval_join(rows, rows, "s", "e").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "note" not in plan and "repeat" not in plan
    ends = [(i * 10, i * 10 + (3000 if i % 100 == 0 else 4)) for i in range(400)]
    want = sorted((i, j) for i, x in enumerate(ends) for j, y in enumerate(ends) if x[0] <= y[1] and y[0] <= x[1])
    assert sorted((r.a, r.b) for r in met.collect()) == want


@pytest.mark.parametrize("alike", [3, 512])
def test_interval_join_of_equal_intervals(spark, monkeypatch, alike):
    """Rows of one interval are joined as one for up to `alike` of them, and laid out again with all their columns, nulls too."""
    monkeypatch.setattr(relational, "ALIKE", alike)
    ends = [(0, 9), (0, 9), (5, 5), (9, 4000), (4000, 4001), (4002, 4002)]
    rows = [(None if i % 5 == 0 else i, None if i % 3 == 0 else f"n{i % 4}", i % 2, *ends[i % 6]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, note string, k int, s long, e long").repartition(3)
    for by in ([], ["k"]):
        got = sorted(str((tuple(r.l), tuple(r.r))) for r in relational.interval_join(df, df, "s", "e", by).collect())
        assert got == sorted(str((x, y)) for x in rows for y in rows if x[3] <= y[4] and y[3] <= x[4] and (not by or x[2] == y[2]))


def test_pairs_of_equal_intervals_take_little_space(spark, tmp_path):
    """A result that grows with the square of equal intervals is written in much less than its own numbers, as pairs of the same rows follow each other."""
    rows = spark.range(60 * 300).selectExpr("id", "id % 300 * 97 AS s", "id % 300 * 97 + 100 + id % 300 * 7 % 211 AS e").repartition(5, F.xxhash64("id"))
    met = relational.interval_join(rows, rows, "s", "e").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    met.write.parquet(str(tmp_path / "met"))
    ends = [(i * 97, i * 97 + 100 + i * 7 % 211) for i in range(300)]
    want = 3600 * sum(x[0] <= y[1] and y[0] <= x[1] for x in ends for y in ends)
    assert spark.read.parquet(str(tmp_path / "met")).distinct().count() == want
    assert sum(f.stat().st_size for f in (tmp_path / "met").glob("*.parquet")) < want * 0.25
