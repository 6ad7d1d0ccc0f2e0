"""Words and hashes of many texts at once, on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than these.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def small_batches(df: DataFrame, rows: int = 1000, size: str = "16m") -> None:
    """Texts are long: Arrow batches of Spark's default number of rows and bytes would take much memory in each task.

    Lowers the session's number of rows where it is higher, and bounds the bytes; that changes no result.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key, "10000"))
    if not 0 < now <= rows:
        conf.set(key, str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def row_key(*columns: str) -> Column:
    """128 bits of hash over these columns of a row: equal just when all of them are, nulls included.

    Values are led by their length, so that none runs into the next.
    """
    part = lambda c: F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
    return F.unhex(F.md5(F.concat(*[F.coalesce(part(F.col(c)), F.lit("n")) for c in columns])))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_powers: dict[int, _Powers] = {}


def batches(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes of text each; a longer text is a range of its own."""
    lengths = np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


class Words:
    """The words of a column of texts (null: none), which are maximal runs of bytes other than those of `outside`.

    data: all bytes; offsets: where each text starts; starts, ends: byte range of each word;
    first: index of the first word of each text, with the number of words at the end.
    """

    def __init__(self, texts: pa.Array, outside: np.ndarray = SPACE):
        raw = [t.encode() if t is not None else b"" for t in texts.to_pylist()]
        self.data = data = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)), out=self.offsets[1:])
        n = len(data)
        self.inside = inside = ~outside[data]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = self.offsets[1:-1]
            before[edges[edges < n]] = False
            after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes. which: 0 or 1, independent of each other."""
        p = _powers.setdefault(which, _Powers(_BASES[which]))
        up, down = p.of(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return _mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def document(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def rolling(hashes: np.ndarray, width: int, base: int = 0) -> np.ndarray:
    """Hash of each run of `width` values, by start; the runs cross text borders and the caller masks those."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASES[1 - base]) + hashes[k : k + n]
    return _mixed(out)
