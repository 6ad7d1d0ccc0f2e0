"""Substring deduplication: fixed-block anchors, rolling probes, and extension to maximal exact repeats."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._text import Words, rolling, small_batches

#: Text in a chunk, the unit of work, about; and distinct probes in a bucket of the index, about.
CHUNK_BYTES = 6_000_000
#: Ranges of doc_id that are weighed to make a chunk.
FINE = 8
BUCKET_PROBES = 1_500_000
#: Bits of a probe's hash. A chance match only costs a window's comparison: windows are compared by WINDOW_BITS bits.
PROBE_BITS = 48
WINDOW_BITS = 96


def _pack(values: np.ndarray) -> bytes:
    """Sorted distinct integers as 32-bit gaps; a gap that doesn't fit is an escape and the value itself."""
    gaps = np.diff(values, prepend=np.uint64(0))
    wide = gaps >= 0xFFFFFFFF
    out = np.where(wide, np.uint64(0xFFFFFFFF), gaps).astype("<u4").tobytes()
    return len(values).to_bytes(4, "little") + out + values[wide].astype("<u8").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    gaps = np.frombuffer(blob, "<u4", n, 4).astype(np.uint64)
    wide = gaps == 0xFFFFFFFF
    gaps[wide] = 0
    sums = np.cumsum(gaps, dtype=np.uint64)
    jumps = np.frombuffer(blob, "<u8", int(wide.sum()), 4 + 4 * n) - sums[wide]
    return sums + np.concatenate([np.zeros(1, np.uint64), jumps])[np.cumsum(wide)]


def _merged(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, kind)])


@dataclass(frozen=True)
class Plan:
    """window: words that a repeat has at least; block: words of an anchor, so many that each window holds a whole block."""

    window: int
    buckets: int

    @property
    def block(self) -> int:
        return max(1, (self.window + 1) // 2)

    def cuts(self, sorted_hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that sorted hashes fall into, and where each bucket's share starts, with the end behind the last.

        Buckets are equal ranges of a hash's first 32 bits; only those that the hashes meet are named.
        """
        top = sorted_hashes >> np.uint64(bits - 32)
        found, first = np.unique((top * np.uint64(self.buckets)) >> np.uint64(32), return_index=True)
        return found.astype(np.int64), np.append(first, len(sorted_hashes))


class Chunk:
    """The texts of a chunk in order, their words, rolling probes and blocks."""

    def __init__(self, table: pa.Table, plan: Plan):
        frame = table.select(["doc_id", "text"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        frame = frame.sort_values(["doc_id", "text"], kind="stable", na_position="last")
        self.plan, self.ids = plan, pa.array(frame["doc_id"], pa.int64())
        self.words = Words(pa.array(frame["text"], pa.string()))
        self.hash = self.words.hashes()
        self.doc = self.words.document()
        self.probes = rolling(self.hash, plan.block) >> np.uint64(64 - PROBE_BITS)
        self.whole = self._within(plan.block)
        self.values, self.inverse, self.times = np.unique(self.probes[self.whole], return_inverse=True, return_counts=True)

    def _within(self, width: int) -> np.ndarray:
        """Starts at which a run of this many words stays in its text."""
        n = len(self.doc) - width + 1
        return np.flatnonzero(self.doc[:n] == self.doc[width - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct probes, which of them occur twice or more here, and which are a block: every block-th start of a text."""
        block = np.zeros(len(self.values), bool)
        block[self.inverse[(self.whole - self.words.first[self.doc[self.whole]]) % self.plan.block == 0]] = True
        return self.values, self.times > 1, block

    def windows(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold a hit: their starts, in order, and two hashes. hit: for each distinct probe of index().

        A repeat of window words holds a block that is a hit, in any of window - block + 1 places, so these windows
        are all that can repeat.
        """
        at = self.whole[hit[self.inverse]]
        reach = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(reach, np.maximum(at - (self.plan.window - self.plan.block), 0), 1)
        np.add.at(reach, at + 1, -1)
        full = self._within(self.plan.window)
        starts = full[(np.cumsum(reach) > 0)[full]]
        first = rolling(self.hash, self.plan.window)[starts] if len(starts) else np.zeros(0, np.uint64)
        second = rolling(self.words.hashes(1), self.plan.window, 1)[starts] if len(starts) else first
        return starts, first, second >> np.uint64(128 - WINDOW_BITS)


def _rows(chunk: int, plan: Plan, values: np.ndarray, bits: int, *more: np.ndarray) -> pa.Table:
    """A row for each bucket in which the chunk has values: (bucket, chunk, values, more)."""
    buckets, edges = plan.cuts(values, bits)
    cut = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    columns = [pa.array(buckets, pa.int32()), pa.array([chunk] * len(cut), pa.int32()), pa.array([_pack(values[i:j]) if bits < 64 else values[i:j].tobytes() for i, j in cut], pa.binary())]
    return pa.table([*columns, *(pa.array([(np.packbits(m[i:j]) if m.dtype == bool else m[i:j]).tobytes() for i, j in cut], pa.binary()) for m in more)], names=["bucket", "chunk", "v", *"pq"[: len(more)]])


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _probe(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        values, twice, block = Chunk(table, plan).index()
        return _rows(table["chunk"][0].as_py(), plan, values, PROBE_BITS, twice, block)

    return run


def _answers(bucket: int, chunks: list[int], flags: np.ndarray, sizes: list[int], kind: int) -> pa.Table:
    at = np.cumsum([0, *sizes])
    return pa.table([pa.array(chunks, pa.int32()), pa.array([kind] * len(chunks), pa.int32()), pa.array([bucket] * len(chunks), pa.int32()), pa.array([np.packbits(flags[i:j]).tobytes() for i, j in zip(at, at[1:])], pa.binary())], names=["chunk", "kind", "bucket", "flags"])


def _match(table: pa.Table) -> pa.Table:
    """A bucket of the index: a probe is a hit if a block has its hash and it occurs in two places."""
    bucket, chunks = table["bucket"][0].as_py(), table["chunk"].to_pylist()
    values = [_unpack(b) for b in table["v"].to_pylist()]
    sizes = [len(v) for v in values]
    twice, block = (_merged([_flags(b, n) for b, n in zip(table[c].to_pylist(), sizes)], bool) for c in "pq")
    _, inverse, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    good = times > 1
    good[inverse[twice]] = True
    indexed = np.zeros(len(times), bool)
    indexed[inverse[block]] = True
    return _answers(bucket, chunks, (good & indexed)[inverse], sizes, 0)


def _hits(answers: pa.Table, kind: int, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The answers of one kind, a bit for each of the chunk's values; cuts: of those values."""
    buckets, edges = cuts
    mine = answers.filter(pa.compute.equal(answers["kind"], kind))
    out = np.zeros(edges[-1], bool)
    at = np.searchsorted(buckets, np.asarray(mine["bucket"].to_numpy(), np.int64))
    for i, f in zip(at.tolist(), mine["flags"].to_pylist()):
        out[edges[i] : edges[i + 1]] = _flags(f, int(edges[i + 1] - edges[i]))
    return out


def _distinct_windows(chunk: Chunk, hit: np.ndarray):
    """(starts, inverse, first, second, earliest): the chunk's distinct windows by hash, and the earliest start of each."""
    starts, first, second = chunk.windows(hit)
    order = np.lexsort((starts, second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return starts, inverse, a[new], b[new], order[new]


def _extend(plan: Plan):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _rows(0, plan, np.zeros(0, np.uint64), 64, np.zeros(0, np.uint32))
        chunk = Chunk(table, plan)
        hit = _hits(answers, 0, plan.cuts(chunk.values, PROBE_BITS))
        _, _, first, second, _ = _distinct_windows(chunk, hit)
        return _rows(table["chunk"][0].as_py(), plan, first, 64, second.astype("<u4"))

    return run


def _settle(table: pa.Table) -> pa.Table:
    """A bucket of windows: each belongs to the first chunk that has it; the others are told that it starts earlier."""
    bucket = table["bucket"][0].as_py()
    table = table.sort_by("chunk")
    values = [np.frombuffer(b, "<u8") for b in table["v"].to_pylist()]
    sizes = [len(v) for v in values]
    first = np.concatenate(values)
    second = np.concatenate([np.frombuffer(b, "<u4") for b in table["p"].to_pylist()])
    order = np.lexsort((np.arange(len(first)), second, first))
    a, b = first[order], second[order]
    again = np.zeros(len(a), bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    flags = np.zeros(len(a), bool)
    flags[order] = again
    return _answers(bucket, table["chunk"].to_pylist(), flags, sizes, 1)


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,end:int>>"


def _remove(plan: Plan):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, plan)
        words = chunk.words
        hit = _hits(answers, 0, plan.cuts(chunk.values, PROBE_BITS))
        starts, inverse, first, _, earliest = _distinct_windows(chunk, hit)
        repeated = _hits(answers, 1, plan.cuts(first, 64))[inverse]
        own = np.ones(len(starts), bool)
        own[earliest] = False
        at = starts[repeated | own]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + plan.window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        n_words = np.diff(words.first)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        data, digests, spans = words.data.tobytes(), [], []
        for i in range(len(n_words)):
            a, b = words.first[i], words.first[i + 1]
            kept = np.flatnonzero(~gone[a:b]) + a
            digests.append(hashlib.sha256(b" ".join([data[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist())])).hexdigest())
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]))).tolist() if removed[i] else []
            spans.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
        return pa.table([chunk.ids, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"])

    return run


def _chunk_numbers(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with chunk, and the bytes of their texts. Chunks are ranges of doc_id of about CHUNK_BYTES of text, in order; then those of null ids, by hash of the text.

    Fine ranges of doc_id are weighed, and neighbours put together while they fit. What goes to the driver and back to the
    tasks is a few numbers for each CHUNK_BYTES of text.
    """
    weighed = docs.select("doc_id", F.octet_length("text").alias("bytes"))
    size, size_null = weighed.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("bytes"))), F.lit(0))).first()
    fine = FINE * -(-size // CHUNK_BYTES)
    bounds: list[int] = []
    if fine > FINE:
        shares = [k / fine for k in range(1, fine)]
        ids = weighed.filter("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * fine))).first()[0] or []
        bounds = sorted(set(ids))
    context = docs.sparkSession.sparkContext
    ranges = _numbered(context.broadcast(np.array(bounds, np.int64)))
    sums = dict(weighed.filter("doc_id IS NOT NULL").groupBy(ranges("doc_id").alias("r")).agg(F.sum("bytes")).collect()) if bounds else {}
    cuts, total = [], 0
    for r, bound in enumerate(bounds, 1):
        here, following = sums.get(r - 1) or 0, sums.get(r) or 0
        total += here
        if total + following > CHUNK_BYTES:
            cuts.append(bound)
            total = 0
    chunks = _numbered(context.broadcast(np.array(cuts, np.int64)))
    of_null = len(cuts) + 1 + F.pmod(F.xxhash64("text"), F.lit(max(1, -(-size_null // CHUNK_BYTES)))).cast("int")
    return docs.withColumn("chunk", F.when(F.col("doc_id").isNull(), of_null).otherwise(chunks("doc_id"))), size


def _numbered(edges):
    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges.value, ids.fillna(0).astype("int64").to_numpy()), dtype="int32")

    return number


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and repeats, the maximal runs of removed words (end exclusive).

    Words are runs of characters other than ASCII white space. A word goes if a window of `window` words that covers
    it also starts earlier: in a smaller doc_id, or before in the same document. Windows are judged on the input.
    kept_sha256 is of the kept words joined by a space. A null or empty text has no words; shorter texts than a window
    stay whole. Rows with the same doc_id count in order of their texts; null ids come last, by a hash of their texts where
    they fill several chunks. Every row gives a row; repeated rows repeat each other. An empty table gives an empty result,
    and other columns aren't looked at. A text longer than a chunk is one chunk, with memory of some 60 times its bytes.

    The texts are dealt out once, to chunks in order of doc_id. Each chunk indexes its non-overlapping blocks and probes
    with every rolling window of a block's length; a probe that meets a block in another place is a hit. Windows around
    hits are compared by 96 bits of hash over all their words and thereby extended to maximal repeats. Chunks only send
    packed distinct hashes by hash range, and get a bit for each back, so a passage in a third of all documents is one
    entry a chunk.
    """
    small_batches(docs)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks, size = _chunk_numbers(slim)
    plan = Plan(window, max(1, -(-size // 6 // BUCKET_PROBES)))
    sent = "bucket int, chunk int, v binary, p binary"
    got = "chunk int, kind int, bucket int, flags binary"
    by_chunk = chunks.groupBy("chunk")
    hits = by_chunk.applyInArrow(_probe(plan), f"{sent}, q binary").groupBy("bucket").applyInArrow(_match, got)
    extended = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_extend(plan), sent)
    settled = extended.groupBy("bucket").applyInArrow(_settle, got)
    return by_chunk.cogroup(hits.union(settled).groupBy("chunk")).applyInArrow(_remove(plan), _RESULT)
