import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing


def levels(sizes, share=1.5, most=2):
    """Targets by handing out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free = dict.fromkeys(order, 0.0), set(order)
    rest = share * sum(sizes.values())
    while free and rest > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= most * sizes[s]:
                target[s] = float(most * sizes[s])
                free.discard(s)
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, found):
    sizes, taken, target, count = {}, {}, {}, {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    for r in found:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    want = levels(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == int(target[s])


def test_targets_and_sizes(make, corpus):
    found = mixing.mix(make(corpus)).collect()
    assert sorted((r.doc_id, r.size) for r in found if r.doc_id is not None) == sorted((r[0], size(r[1])) for r in corpus if r[0] is not None)
    check(corpus, found)


def test_capped_sources(make):
    rows = [(i, "a b c", "big") for i in range(100)] + [(200, "x " * 10, "aaa"), (201, "y", None), (202, "", "empty")]
    check(rows, mixing.mix(make(rows)).collect())


def test_reruns_and_partitions_agree(make, corpus, rows_of):
    docs = make(corpus)
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs.repartition(7)))


def test_sql_agrees(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(duckdb.sql(mixing.MIX_SQL.format(documents="documents")).fetchall(), key=repr)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_position_inverts_the_integral(spark):
    """What a source has handed out by a position, its rates summed in small steps, is the part asked for."""
    parts = [k / 20 for k in range(21)]
    for start, end in mixing.SCHEDULE:
        rows = spark.createDataFrame([(p,) for p in parts], "part double").select("part", mixing.position(F.col("part"), F.lit(start), F.lit(end)).alias("at")).collect()
        for r in rows:
            steps = 4000
            done = sum((start + (end - start) * r.at * (i + 0.5) / steps) * r.at / steps for i in range(steps))
            assert done == pytest.approx(r.part, abs=1e-6) and 0 <= r.at <= 1


def test_sources_come_early_or_late(make):
    """Halfway through training a source whose rate falls has handed out three quarters, one whose rate rises one."""
    rows = [(i, "one two three four", s) for s, base in (("a", 0), ("b", 1000), ("c", 2000)) for i in range(base, base + 400)]
    out = mixing.mixed_documents(make(rows))
    order = [r.source for r in out.collect()]
    early = {s: order[: len(order) // 2].count(s) / order.count(s) for s in "abc"}
    assert early["a"] > 0.55 > 0.53 > early["b"] > early["c"]


def test_mixed_documents(make, corpus):
    docs = make(corpus)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + size(r.text)
        assert r.n_chars == len(r.text)
    sizes = {}
    for _, text, source in corpus:
        sizes[source] = sizes.get(source, 0) + size(text)
    assert words == {s: int(t) for s, t in levels(sizes).items() if int(t)}


def test_columns_of_any_name(make, rows_of):
    docs = make([(1, "a b c", "s"), (2, "d e f", "t")]).withColumnRenamed("bucket", "odd.name")
    assert mixing.mixed_documents(docs).columns == docs.columns and len(rows_of(mixing.mixed_documents(docs), "doc_id")) >= 2


def test_order_is_by_hash_of_ids_and_texts(make):
    rows = [(i, "w", "s") for i in range(50)]
    found = sorted(mixing.mix(make(rows)).collect(), key=lambda r: r.position if r.position is not None else 2)
    assert [r.doc_id for r in found] == sorted(range(50), key=lambda i: hashlib.md5(f"{i}:{hashlib.md5(b'w').hexdigest()}".encode()).hexdigest())


def test_empty_table(make, rows_of):
    assert rows_of(mixing.mix(make([]))) == [] and rows_of(mixing.mixed_documents(make([]))) == []
