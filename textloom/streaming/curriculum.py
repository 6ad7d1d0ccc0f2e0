"""The dynamic curriculum as a stream: losses come in, and each difficulty's count, sum and mean are kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.curriculum import softmax_weights

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningLoss(StatefulProcessor):
    """Keeps (n, units) of a difficulty, and gives out its new figures with each batch that has a loss of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.figures = handle.getValueState("figures", "n long, units long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, units = self.figures.get() if self.figures.exists() else (0, 0)
        for part in rows:
            n, units = n + len(part), units + int(part["units"].sum())
        self.figures.update((n, units))
        yield pd.DataFrame({"difficulty": [key[0]], "n": [n], "units": [units]})

    def close(self) -> None:
        pass


#: Losses are summed in millionths, in whole numbers, so a sum doesn't depend on how a stream was cut.
UNIT = 1_000_000


def _in_units(losses: DataFrame, group: str, loss: str) -> DataFrame:
    return losses.filter(F.col(group).isNotNull() & F.col(loss).isNotNull()).select(F.col(group).cast("string").alias("difficulty"), F.round(F.col(loss) * UNIT).cast("long").alias("units"))


def running_losses(losses: DataFrame, group: str = "difficulty", loss: str = "loss") -> DataFrame:
    """A stream of losses to a stream (difficulty, n, units) of figures since its beginning, one row for a difficulty and batch.

    State is one row for each difficulty, whatever the length of the stream; a query that is started again from its checkpoint
    goes on from there. Rows with a null group or loss are left out. The session's state store has to be RocksDB.
    """
    spark = losses.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return _in_units(losses, group, loss).groupBy("difficulty").transformWithStateInPandas(RunningLoss(), "difficulty string, n long, units long", "Update", "None")


def totals(losses: DataFrame, group: str = "difficulty", loss: str = "loss") -> DataFrame:
    """What running_losses() comes to over a table."""
    return _in_units(losses, group, loss).groupBy("difficulty").agg(F.count("*").alias("n"), F.sum("units").alias("units"))


def latest(written: DataFrame) -> DataFrame:
    """The last figures of each difficulty among those that a stream has written; n only grows."""
    return written.groupBy("difficulty").agg(F.max_by("units", "n").alias("units"), F.max("n").alias("n")).select("difficulty", "n", "units")


def weights(figures: DataFrame, temperature: float = 1.0) -> DataFrame:
    """figures with avg_loss and weight, the softmax over difficulties."""
    return softmax_weights(figures.withColumn("avg_loss", F.col("units") / UNIT / F.col("n")), "avg_loss", temperature).drop("units")
