"""Writers of corpora, splits and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8; null fields are left out."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def write_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A frame of few rows, such as a one-row aggregate, as a single JSON file."""
    stats.coalesce(1).write.mode(mode).json(path)


def rounded_scores(pairs: DataFrame, columns: tuple[str, ...] = ("similarity_score", "length_ratio"), digits: int = 4) -> DataFrame:
    """pairs with scores as they are written, to some digits; columns that aren't there are passed over."""
    return pairs.withColumns({c: F.round(c, digits) for c in columns if c in pairs.columns})


def write_csv_report(df: DataFrame, path: str, mode: str = "errorifexists", mark: bool = False) -> None:
    """A frame of few rows as one CSV file with a header; mark: led by a byte order mark, by which spreadsheets know UTF-8."""
    if mark:
        df = df.select(F.col(df.columns[0]).alias("\ufeff" + df.columns[0]), *df.columns[1:])
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, column: str = "split", mode: str = "errorifexists") -> None:
    """A folder for each value of column, in one pass over df."""
    df.write.mode(mode).partitionBy(column).json(path)
