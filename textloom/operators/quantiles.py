"""Exact quantiles by narrowing histograms: the values stay where they are, and a group is at most some bins in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialise

#: Bins of a round, for each rank that is looked for.
BINS = 4096


def quantiles(df: DataFrame, value: str, probabilities: list[float], groups: list[str], names: list[str]) -> DataFrame:
    """(groups, names): for each group the quantiles at the probabilities, interpolated between the two nearest ranks, in doubles.

    The same as Spark's percentile(), which holds all distinct values of a group in one task. Here each rank is in a range of
    values, at first all of them; a round counts the values of each range in BINS bins, and the bin with the rank is the next range, until
    it holds one value. Rounds read the values again; what meets are counts. Null values are left out, and a group without others
    isn't in the result (without groups there is one row, of nulls). NaN isn't a value here.
    """
    rows = df.select(*groups, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL AND NOT isnan(__v)")
    whole = rows.groupBy(*groups).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    place = lambda p: F.lit(float(p)) * (F.col("__n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")) for p in probabilities])))
    state = materialise(whole.filter("__n > 0").select(*groups, "__n", F.explode(ranks).alias("__rank"), F.lit(0).cast("long").alias("__before"), "__low", "__high"), "ranks")
    while not state.filter("__low < __high").isEmpty():
        state = materialise(_narrowed(rows, state, groups).unionByName(state.filter("__low = __high")), "ranks")
    found = state.select(*groups, "__n", "__rank", F.col("__low").alias("__v"))
    at = found.groupBy(*groups, "__n").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))

    def interpolated(p: float) -> Column:
        low, high = F.col("__at")[F.floor(place(p)).cast("long")], F.col("__at")[F.ceil(place(p)).cast("long")]
        # As percentile() weighs them.
        return F.when(low == high, low).otherwise((F.ceil(place(p)) - place(p)) * low + (place(p) - F.floor(place(p))) * high)

    out = at.select(*groups, *[interpolated(p).alias(n) for p, n in zip(probabilities, names)])
    return out if groups else df.sparkSession.range(1).join(out, F.lit(True), "left").drop("id")


def _narrowed(rows: DataFrame, state: DataFrame, groups: list[str]) -> DataFrame:
    """The open ranks of state, each with the bin of its range that holds it as the new range."""
    open_ = state.filter("__low < __high").select(*[F.col(c).alias(f"__of_{c}") for c in groups], "__n", "__rank", "__before", "__low", "__high")
    same = F.col("__v").between(F.col("__low"), F.col("__high"))
    for c in groups:
        same &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    # Few rows, two for each probability and group; Spark sends them to the values where they are few.
    met = rows.join(open_ if groups else F.broadcast(open_), same)
    # Halves, as the difference of two doubles may be none.
    share = (F.col("__v") / 2 - F.col("__low") / 2) / (F.col("__high") / 2 - F.col("__low") / 2)
    bin_ = F.least(F.floor(share * BINS).cast("int"), F.lit(BINS - 1))
    # A range of neighbouring doubles may fall into one bin: its ends are bins of their own.
    bin_ = F.when(F.col("__v") == F.col("__low"), -1).when(F.col("__v") == F.col("__high"), BINS).otherwise(bin_)
    keys = [*groups, "__n", "__rank", "__before"]
    counts = met.groupBy(*keys, bin_.alias("__bin")).agg(F.count("*").alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    to = F.sum("__c").over(Window.partitionBy(*groups, "__rank").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__before")
    hit = counts.withColumn("__to", to).filter((F.col("__rank") < F.col("__to")) & (F.col("__rank") >= F.col("__to") - F.col("__c")))
    return hit.select(*groups, "__n", "__rank", (F.col("__to") - F.col("__c")).alias("__before"), "__low", "__high")
