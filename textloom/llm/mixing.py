"""Mixing sources to target weights: a curriculum whose weights change over training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialise

#: Weights of the sources in their order, and how a source's share of the stream changes from the start of training to
#: its end (the mean of the two is 1); both repeat.
WEIGHTS = (3, 1, 2)
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Rows, about, in each share of the hash order; a source's cumulative sizes are summed apart in them.
BUCKET_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def _cycle(values: list[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, size) to (source, source_size, rank, weight, target), a row for each source.

    Sources are in code point order, null last, and share `share` times all sizes by weight; a target stops at
    `most` times its source's size, and the excess goes to the others by weight until none is above. That is
    least(most * size, level * weight) for one level: sources in order of most * size / weight are full
    below it, and the first that is not gives the level. The windows run over sources, not rows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.select("source", F.col("size").alias("source_size"), (F.row_number().over(order) - 1).alias("rank"))
    ranked = ranked.withColumn("weight", _cycle(list(weights), F.col("rank")).cast("long"))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = ranked.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(every)).alias("demand"),
        F.coalesce(F.sum("source_size").over(before) * most, F.lit(0)).alias("full"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest"),
    )
    steps = steps.withColumn("level", (F.col("demand") - F.col("full")) / F.col("rest"))
    fits = F.col("level") * F.col("weight") <= most * F.col("source_size")
    # No source fits only where most <= share; all are full then.
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(every)
    full = (most * F.col("source_size")).cast("double")
    return steps.select("source", "source_size", "rank", "weight", F.coalesce(F.least(full, level * F.col("weight")), full).alias("target"))


def position(part: Column, start: Column, end: Column) -> Column:
    """When in training, from 0 to 1, a source has handed out this part of its target.

    Its rate runs linearly from start to end; the integral start * t + (end - start) * t**2 / 2 is inverted.
    """
    curve = end - start
    return F.when(curve == 0, part).otherwise((F.sqrt(start * start + 2 * curve * part) - start) / curve)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """doc_id, source, size in words, and the hash that orders a source's documents, of id and text: null ids differ in it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary")).alias("h"),
        *more,
    )


def _bucketed(sized: DataFrame, rows: int) -> DataFrame:
    """sized with bucket: equal ranges of the hash, as many as give BUCKET_ROWS of so many rows."""
    n = max(1, -(-rows // BUCKET_ROWS))
    return sized.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * n, 32))


def _placed(sized: DataFrame, per_bucket: DataFrame, share: float, most: int, weights: tuple[int, ...], schedule: tuple) -> DataFrame:
    """sized with source_size, target, start (where the document's first pass begins in its source), taken and position."""
    of_source = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("size")), share, most, weights)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(of_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # The window and the join are by the same columns without nulls, so rows, texts among them, are dealt out once for both.
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key")
    inside = Window.partitionBy("key", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.select("*", key).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets.select("*", key).drop("source"), ["key", "bucket"]).withColumn("start", F.col("offset") + F.col("within"))
    quota = F.floor("target")
    taken = sum((F.greatest(F.least(quota - F.col("start") - k * F.col("source_size"), F.col("size")), F.lit(0)) for k in range(most)), F.lit(0))
    rates = [_cycle([r[i] for r in schedule], F.col("rank")) for i in (0, 1)]
    at = position(F.col("start") / F.col("target"), *rates)
    return placed.withColumn("taken", taken.cast("long")).withColumn("position", F.when(F.col("taken") > 0, at))


def _per_bucket(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, schedule: tuple = SCHEDULE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken, and position (of its first use, or null).

    size is the number of words (null text: 0). In each source the documents are in order of an MD5 of their ids and texts;
    pass after pass they fill the interval from 0 to the target, each size long, and a document takes what falls into
    it: taken words, of which the last document's may be cut. So a source's taken words are its target, rounded down.
    position is where its first word is asked for by the source's schedule.

    Rows that are equal in id and text follow each other. A null source is a source, the last. Nulls, ties and repeated rows
    give a row each; an empty table gives an empty result. The order doesn't depend on partitions, so reruns agree.

    Cumulative sizes come from sums of ranges of the hash, and windows within a range of some BUCKET_ROWS rows, so no task
    gets a source as a whole.
    """
    return _mix(docs, share, most, weights, schedule, id_col, text_col, source_col).drop("h")


def mix_in_order(docs: DataFrame) -> DataFrame:
    """mix(), range-sorted by position; the hash of a document breaks ties, also among those without a position."""
    return _mix(docs, 1.5, 2, WEIGHTS, SCHEDULE, "doc_id", "text", "source").orderBy("position", "h", "size").drop("h")


def _mix(docs: DataFrame, share: float, most: int, weights: tuple[int, ...], schedule: tuple, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sizes = materialise(_sized(docs, id_col, text_col, source_col), "sizes")
    sized = _bucketed(sizes, sizes.count())
    placed = _placed(sized, _per_bucket(sized), share, most, weights, schedule)
    return placed.select("doc_id", "size", "source", "source_size", "target", "taken", "position", "h")


def mixed_documents(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, schedule: tuple = SCHEDULE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of documents, range-sorted by position: a row for each pass that takes the document.

    The columns are those of docs. Where a pass takes a part of a text, the row has its first words, joined by a space,
    and n_chars, where there is such a column, counts those. Documents without words, null texts among them, are never
    asked for. A null source is a source; repeated rows count each; an empty table stays empty. Ties in position are broken
    by the documents' hashes, so the order is the same on reruns.
    The texts are dealt out twice: by range of the hash, and by position.
    """
    columns, rows = docs.columns, docs.count()
    per_bucket = materialise(_per_bucket(_bucketed(_sized(docs, id_col, text_col, source_col), rows)), "bucket-sizes")
    sized = _bucketed(_sized(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")), rows)
    placed = _placed(sized, per_bucket, share, most, weights, schedule).filter("taken > 0")
    # A later pass comes at its own place on the schedule.
    rates = [_cycle([r[i] for r in schedule], F.col("rank")) for i in (0, 1)]
    uses = placed.select("doc", "h", "size", "taken", "start", "source_size", "target", *[r.alias(f"rate{i}") for i, r in enumerate(rates)], F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))).alias("pass"))
    words = F.least("size", F.col("taken") - F.col("pass") * F.col("size")).cast("int")
    at = position((F.col("start") + F.col("pass") * F.col("source_size")) / F.col("target"), F.col("rate0"), F.col("rate1"))
    text = F.col("doc")[text_col]
    part = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, words), " ")
    cut = F.when(words < F.col("size"), part)
    changed = {text_col: F.coalesce(cut, text), "n_chars": F.coalesce(F.length(cut).cast("long"), F.col("doc")["n_chars"]) if "n_chars" in columns else None}
    out = uses.select(at.alias("at"), "h", "pass", F.struct(*[(changed[c] if c in changed else F.col("doc")[c]).alias(c) for c in columns]).alias("doc"))
    return out.orderBy("at", "h", "pass").select("doc.*")


#: The same in DuckDB's SQL, over a table documents.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM {documents}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM per_source),
weighed AS (SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM ranked),
steps AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS demand,
         coalesce(sum(source_size) OVER before, 0) * 2 AS filled,
         (sum(w) OVER ()) - coalesce(sum(w) OVER before, 0) AS rest
  FROM weighed WINDOW before AS (ORDER BY source_size::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (demand - filled::DOUBLE) / rest::DOUBLE AS level FROM steps),
level AS (
  SELECT level AS found FROM levels WHERE level * w <= 2 * source_size ORDER BY source_size::DOUBLE / w, r LIMIT 1),
targets AS (
  SELECT source, source_size, r, coalesce(least((2 * source_size)::DOUBLE, found * w), (2 * source_size)::DOUBLE) AS target
  FROM levels LEFT JOIN level ON true),
placed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, t.r,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, (greatest(least(floor(target)::BIGINT - start, size), 0) + greatest(least(floor(target)::BIGINT - start - source_size, size), 0))::BIGINT AS taken,
         CASE r % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS a, CASE r % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS b
  FROM placed)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN b = a THEN start::DOUBLE / target ELSE (sqrt(a * a + 2 * (b - a) * (start::DOUBLE / target)) - a) / (b - a) END END AS position
FROM took
"""
