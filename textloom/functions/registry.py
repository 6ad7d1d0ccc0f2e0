"""The builders in SQL: functions that Catalyst inlines, a table function with its own partitioning, and an aggregate on Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from textloom.operators.cleaning import CleaningRules
from textloom.operators.filtering import FilterRules
from textloom.operators.splits import LENGTH_BOUNDS


def _bucket(bounds: tuple[int, ...]) -> str:
    return "CASE " + " ".join(f"WHEN n <= {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"


def _reason(r: CleaningRules) -> str:
    return f"""CASE WHEN coalesce(trim(src) = '', true) OR coalesce(trim(tgt) = '', true) THEN 'empty' WHEN length(src) NOT BETWEEN {r.min_src} AND {r.max_src} THEN 'zh_length'
 WHEN length(tgt) NOT BETWEEN {r.min_tgt} AND {r.max_tgt} THEN 'en_length' WHEN length(src) / greatest(length(tgt), 1) NOT BETWEEN {r.min_ratio}D AND {r.max_ratio}D THEN 'ratio' ELSE 'valid' END"""


def functions(cleaning: CleaningRules = CleaningRules(), filtering: FilterRules = FilterRules(), bounds: tuple[int, ...] = LENGTH_BOUNDS) -> list[tuple[str, str, str, str]]:
    """Name, arguments, type, body. Bodies are SQL, so a call costs what the expression costs; limits are those of the rules."""
    ratio = "CASE WHEN length(b) > 0 THEN length(a) / length(b) ELSE 0.0D END"
    return [
        ("collapse_space", "s STRING", "STRING", r"trim(regexp_replace(s, '(?U)\\s+', ' '))"),
        ("strip_tags", "s STRING", "STRING", "regexp_replace(s, '<[^>]+>', '')"),
        ("word_count", "s STRING", "INT", r"size(filter(split(s, '(?U)\\s+'), w -> w <> ''))"),
        ("pair_hash", "a STRING, b STRING", "STRING", "md5(concat(trim(a), '|||', trim(b)))"),
        ("length_ratio", "a STRING, b STRING", "DOUBLE", ratio),
        ("ratio_passes", "a STRING, b STRING", "BOOLEAN", f"{ratio} BETWEEN {filtering.min_ratio}D AND {filtering.max_ratio}D"),
        ("reject_reason", "src STRING, tgt STRING", "STRING", _reason(cleaning)),
        ("length_bucket", "n INT", "INT", _bucket(bounds)),
        ("cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)) * sqrt(aggregate(transform(b, x -> x * x), 0D, (s, x) -> s + x)))"),
    ]


@F.udtf
class PackBatches:
    """pack_batches(TABLE(t), budget): rows (bucket, shard, id, n) to (bucket, shard, id, batch): batches, from 0 on, of at most `budget` n.

    Each bucket and shard is packed apart, in the order of id; the function asks for that partitioning itself. A row that is
    larger than the budget is a batch alone. What is kept is two numbers, so a shard may be of any length.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        missing = [c for c in ("bucket", "shard", "id", "n") if c not in kinds]
        if missing:
            raise ValueError(f"the table lacks {missing}")
        schema = T.StructType([*[T.StructField(c, kinds[c]) for c in ("bucket", "shard", "id")], T.StructField("batch", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("bucket"), PartitioningColumn("shard")], orderBy=[OrderingColumn("id")])

    def __init__(self):
        self.batch, self.used = -1, 0

    def eval(self, row, budget: int):
        n = row["n"] or 0
        if self.batch < 0 or self.used + n > budget:
            self.batch, self.used = self.batch + 1, 0
        self.used += n
        yield row["bucket"], row["shard"], row["id"], self.batch


@F.arrow_udf(T.DoubleType())
def entropy_of_counts(counts: pa.Array) -> float:
    """Entropy, in bits, of a distribution given by counts, such as those of words; nulls and zeros don't count."""
    n = np.asarray(counts.drop_null()).astype(float)
    n = n[n > 0]
    p = n / n.sum() if len(n) else n
    return float(-(p * np.log2(p)).sum())


def register(spark: SparkSession, cleaning: CleaningRules = CleaningRules(), filtering: FilterRules = FilterRules(), bounds: tuple[int, ...] = LENGTH_BOUNDS) -> list[str]:
    """Make the functions known to the session's SQL, with the limits of these rules; returns their names."""
    named = functions(cleaning, filtering, bounds)
    for name, arguments, kind, body in named:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("pack_batches", PackBatches)
    spark.udf.register("entropy_of_counts", entropy_of_counts)
    return [*[f[0] for f in named], "pack_batches", "entropy_of_counts"]
