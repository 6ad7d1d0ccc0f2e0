"""Readers of pair corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import contains_han
from textloom.operators.order import ranked, shuffle_key

CORRUPT = "_corrupt"


def pair_schema(src: str = "chinese", tgt: str = "english") -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, t in ((src, T.StringType()), (tgt, T.StringType()), ("source", T.StringType()), ("score", T.DoubleType()))])


def _pairs(df: DataFrame, src: str, tgt: str) -> DataFrame:
    """Missing texts are empty."""
    return df.select(F.coalesce(src, F.lit("")).alias("src"), F.coalesce(tgt, F.lit("")).alias("tgt"), "source", "score")


def read_jsonl(spark: SparkSession, path: str, src: str = "chinese", tgt: str = "english") -> DataFrame:
    """Pairs of JSON lines; blank and malformed lines are skipped."""
    return _pairs(spark.read.schema(pair_schema(src, tgt)).option("mode", "DROPMALFORMED").json(path), src, tgt)


def read_jsonl_rejects(spark: SparkSession, path: str, src: str = "chinese", tgt: str = "english") -> DataFrame:
    """The malformed lines that read_jsonl skips."""
    schema = T.StructType([*pair_schema(src, tgt).fields, T.StructField(CORRUPT, T.StringType())])
    # The JSON source refuses queries for the corrupt column alone, so lines are read as text and parsed.
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.filter(parsed[CORRUPT].isNotNull()).select(F.col("value").alias("line"))


def is_json_array(spark: SparkSession, path: str, peek: int = 1024) -> bool:
    """Whether the first non-blank character among the first `peek` of the first line that has one is [."""
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, peek)).first()
    return bool(first) and first[0].startswith("[")


def read_json(spark: SparkSession, path: str, src: str = "chinese", tgt: str = "english") -> DataFrame:
    """A JSON array or JSON lines, whichever the file is. An array is read by one task; large corpora come as lines."""
    if is_json_array(spark, path):
        return _pairs(spark.read.schema(pair_schema(src, tgt)).option("multiLine", True).option("mode", "DROPMALFORMED").json(path), src, tgt)
    return read_jsonl(spark, path, src, tgt)


def read_directory(spark: SparkSession, path: str, src: str = "chinese", tgt: str = "english", recursive: bool = False) -> DataFrame:
    """All *.json and *.jsonl files of JSON lines in a directory, with file, the name of each row's file. Unreadable files are skipped."""
    reader = spark.read.schema(pair_schema(src, tgt)).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True)
    rows = reader.option("pathGlobFilter", "*.json*").option("recursiveFileLookup", recursive).json(path)
    return rows.select(F.coalesce(src, F.lit("")).alias("src"), F.coalesce(tgt, F.lit("")).alias("tgt"), "source", "score", F.col("_metadata.file_name").alias("file"))


def head(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in a given order; all for None or 0."""
    return df.orderBy(*order).limit(n) if n else df


def discover(spark: SparkSession, directory: str, preferred: tuple[str, ...] = ()) -> list[str]:
    """Paths of the JSON files in a directory: the preferred names that exist, else all, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile())
    found = [n for n in preferred if n in names] or [n for n in names if n.endswith((".json", ".jsonl"))]
    return [f"{directory.rstrip('/')}/{n}" for n in found]


def first_non_empty(*frames: DataFrame) -> DataFrame:
    """The first source that has rows, else the last."""
    return next((f for f in frames[:-1] if not f.isEmpty()), frames[-1])


def read_csv_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a CSV without header: the first two cells, both longer than a character and not only digits."""
    rows = spark.read.schema("a STRING, b STRING").option("header", False).csv(path)
    good = lambda c: (F.length(c) > 1) & ~c.rlike(r"(?U)^\d+$")
    rows = rows.select(F.trim("a").alias("src"), F.trim("b").alias("tgt"))
    return rows.filter(good(F.col("src")) & good(F.col("tgt")))


def read_xml_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of <seg> elements with <src> and <ref>. The side with Han characters is src; where both or neither has any, the pair goes."""
    rows = spark.read.format("xml").option("rowTag", "seg").schema("src STRING, ref STRING").load(path)
    a, b = F.trim("src"), F.trim("ref")
    rows = rows.select(a.alias("a"), b.alias("b")).filter(contains_han(F.col("a")) != contains_han(F.col("b")))
    zh = contains_han(F.col("a"))
    return rows.select(F.when(zh, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(zh, F.col("b")).otherwise(F.col("a")).alias("tgt"))


def numbered_lines(spark: SparkSession, path: str, drop_blank: bool = True) -> DataFrame:
    """(pos, line) of a text file, or of a folder of parts in the order of their names, trimmed; positions count after blank lines went.

    Lines are numbered within ranges of the files and ranges by their counts, so a splittable file isn't read by one task,
    and parts may be read in any order.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("id"), at.alias("part"))
    rows = rows.filter("line <> ''") if drop_blank else rows
    return position(rows, "part", "id").select("pos", "line")


def position(rows: DataFrame, part: str, order: str) -> DataFrame:
    """rows with pos, from 1 on, in the order of parts, and within a part of an increasing id. A part is what a task can sort."""
    from pyspark.sql import Window

    rows = rows.withColumn("part", F.col(part))
    counts = rows.groupBy("part").count()
    # A row for each part, however many lines there are.
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # No part is empty, so the rows before it tell it from others.
    inside = Window.partitionBy("before").orderBy(order)
    return rows.join(F.broadcast(before), "part").drop("part").withColumn("pos", F.col("before") + F.row_number().over(inside)).drop("before")


def read_aligned_text(spark: SparkSession, src_path: str, tgt_path: str, n: int | None = None, drop_blank: bool = True) -> DataFrame:
    """(pos, src, tgt): two files line by line, to the shorter one's end. Blank lines go from each file before the lines meet."""
    a = numbered_lines(spark, src_path, drop_blank).withColumnRenamed("line", "src")
    b = numbered_lines(spark, tgt_path, drop_blank).withColumnRenamed("line", "tgt")
    rows = a.join(b, "pos")
    return rows.filter(F.col("pos") <= n) if n else rows


def read_text_head(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(pos, line) of a text file, also gzipped: its first n lines that aren't blank."""
    rows = numbered_lines(spark, path)
    return rows.filter(F.col("pos") <= n) if n else rows


def generate(spark: SparkSession, n: int, templates: list[tuple[str, str]], source: str = "synthetic") -> DataFrame:
    """n pairs that go round the templates: (pair_id, src, tgt, source)."""
    at: Column = (F.col("id") % len(templates) + 1).cast("int")
    side = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in templates]), at)
    return spark.range(n).select(F.col("id").alias("pair_id"), side(0).alias("src"), side(1).alias("tgt"), F.lit(source).alias("source"))


def sampled(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, the same on every run and for every partitioning: those with the least MD5 of seed and key."""
    return ranked(df, shuffle_key(F.col(key), seed), key, name="__rank").filter(F.col("__rank") <= n).drop("__rank")
