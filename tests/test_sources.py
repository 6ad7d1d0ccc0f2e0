import gzip
import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import adapters, readers, writers


@pytest.fixture
def write(tmp_path):
    def put(name, data):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(path)

    return put


def sides(df):
    return sorted((r.src, r.tgt) for r in df.collect())


def test_jsonl_skips_blank_and_malformed_lines(spark, write):
    path = write("a.jsonl", '{"chinese": "你好", "english": "hi", "source": "s"}\n\n{bad\n{"chinese": "x"}\n')
    assert sides(readers.read_jsonl(spark, path)) == [("x", ""), ("你好", "hi")]
    assert [r.line for r in readers.read_jsonl_rejects(spark, path).collect()] == ["{bad"]


def test_json_array_and_lines_are_told_apart(spark, write):
    rows = [{"chinese": "a", "english": "b"}, {"chinese": "c", "english": "d"}]
    array = write("a.json", "\n  " + json.dumps(rows, indent=1))
    lines = write("b.json", "\n".join(map(json.dumps, rows)))
    assert readers.is_json_array(spark, array) and not readers.is_json_array(spark, lines)
    assert sides(readers.read_json(spark, array)) == sides(readers.read_json(spark, lines)) == [("a", "b"), ("c", "d")]


def test_other_keys(spark, write):
    path = write("k.jsonl", '{"zh": "a", "en": "b"}\n')
    assert sides(readers.read_jsonl(spark, path, "zh", "en")) == [("a", "b")]


def test_directory_and_discovery(spark, write, tmp_path):
    write("d/a.jsonl", '{"chinese": "a", "english": "b"}\n')
    write("d/b.json", '{"chinese": "c", "english": "d"}\n')
    write("d/c.txt", "no")
    found = readers.read_directory(spark, str(tmp_path / "d"))
    assert sides(found) == [("a", "b"), ("c", "d")] and {r.file for r in found.collect()} == {"a.jsonl", "b.json"}
    names = [p.rsplit("/", 1)[1] for p in readers.discover(spark, str(tmp_path / "d"))]
    assert names == ["a.jsonl", "b.json"]
    assert [p.rsplit("/", 1)[1] for p in readers.discover(spark, str(tmp_path / "d"), ("b.json", "z.json"))] == ["b.json"]


def test_csv_pairs(spark, write):
    path = write("t.csv", "1,2\nab,cd\na,bcd\n 你好 ,hello,more\n")
    assert sides(readers.read_csv_pairs(spark, path)) == [("ab", "cd"), ("你好", "hello")]


def test_xml_pairs(spark, write):
    path = write("t.xml", "<set><doc><seg><src>你好</src><ref>hello</ref></seg><seg><src>good</src><ref>好</ref></seg><seg><src>a</src><ref>b</ref></seg></doc></set>")
    assert sides(readers.read_xml_pairs(spark, path)) == [("你好", "hello"), ("好", "good")]


def test_aligned_text(spark, write):
    a, b = write("a.txt", "1\n\n2\n3\n"), write("b.txt", "x\ny\n")
    assert [(r.pos, r.src, r.tgt) for r in readers.read_aligned_text(spark, a, b).orderBy("pos").collect()] == [(1, "1", "x"), (2, "2", "y")]
    assert [(r.src, r.tgt) for r in readers.read_aligned_text(spark, a, b, drop_blank=False).orderBy("pos").collect()] == [("1", "x"), ("", "y")]
    assert readers.read_aligned_text(spark, a, b, 1).count() == 1


def test_gzipped_head(spark, write):
    path = write("m.txt.gz", gzip.compress("\n".join(f"line {i}" for i in range(50)).encode()))
    assert [r.line for r in readers.read_text_head(spark, path, 3).orderBy("pos").collect()] == ["line 0", "line 1", "line 2"]


def test_positions_over_many_files(spark, write, tmp_path):
    for k in range(4):
        write(f"many/{k}.txt", "\n".join(f"{k}-{i}" for i in range(25)))
    found = [r.pos for r in readers.numbered_lines(spark, str(tmp_path / "many")).orderBy("pos").collect()]
    assert found == list(range(1, 101))


def test_lines_of_parts_in_the_order_of_their_names(spark, write, tmp_path):
    """Parts are read largest first; positions go by names, and by places in a part that is read in pieces."""
    for k, n in enumerate((5, 900, 1, 300)):
        write(f"parts/part-{k}.txt", "\n".join(f"{k}-{i}" for i in range(n)))
    want = [(p + 1, x) for p, x in enumerate(f"{k}-{i}" for k, n in enumerate((5, 900, 1, 300)) for i in range(n))]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted((r.pos, r.line) for r in readers.numbered_lines(spark, str(tmp_path / "parts")).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_aligned_round_trip_is_many_tasks(spark, tmp_path, monkeypatch):
    """No file of the round trip has all lines."""
    from textloom.plans import texts

    paths = {name: str(tmp_path / name) for name in ("left", "right")}
    monkeypatch.setattr(texts, "fresh_path", lambda s, name: paths[name])
    (row,) = texts._aligned(spark, "/root/testdata/sf0.001").collect()
    for path in paths.values():
        sizes = [len(p.read_text().splitlines()) for p in (tmp_path / path).glob("part-*")]
        assert sum(sizes) == row.n and len(sizes) > 1 and max(sizes) < row.n


def test_generated_and_sampled(spark):
    rows = readers.generate(spark, 5, [("a", "b"), ("c", "d")])
    assert [r.src for r in rows.orderBy("pair_id").collect()] == ["a", "c", "a", "c", "a"]
    some = readers.sampled(rows, 3, "pair_id")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, readers.sampled(rows.repartition(5), 3, "pair_id").collect()))
    assert readers.first_non_empty(rows.limit(0), rows).count() == 5
    assert readers.head(rows, 2, "pair_id").count() == 2 and readers.head(rows, 0).count() == 5


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("你", None, "train"), ("b", "x", "val")], "src string, source string, split string")
    writers.write_jsonl(rows, str(tmp_path / "j"))
    lines = sorted(x for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"src": "b", "source": "x", "split": "val"}, {"src": "你", "split": "train"}]
    writers.write_splits(rows, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/split=val")).count() == 1
    writers.write_stats(rows.agg(F.count("*").alias("n")), str(tmp_path / "t"))
    writers.write_csv_report(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_pairs_of_lines_and_turns(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "s"), (2, "one", "s"), (3, None, "s"), (4, "", "s")], "doc_id long, text string, source string")
    assert sorted((r.pair_id, r.src, r.tgt) for r in adapters.pairs_lines(docs).collect()) == [(1_000_000, "a", "b"), (1_000_001, "b", "c")]
    turns = spark.createDataFrame([(1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "r"), (2, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    assert [(r.src, r.tgt) for r in adapters.pairs_conversations(turns).collect()] == [("q", "a")]
