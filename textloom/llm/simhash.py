"""SimHash near-duplicates, found at the points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._components import components
from textloom.llm._text import small_batches
from textloom.session import materialise

BITS = 64
#: Groups of at most so many fingerprints at an anchor are compared pair by pair, larger ones by search from member to member.
SMALL = 12
#: Shingles whose bits are counted at once, about.
BLOCK = 16_384


def _shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of a text's shingles, at most BLOCK at a time."""
    words = (text or "").encode().lower().split()
    n, digest = len(words), xxhash.xxh64_intdigest
    if not n:
        return
    joined = b" ".join(words)
    if n <= shingle:
        yield np.array([digest(joined, 42)], "<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts, ends = np.concatenate([[0], ends[: n - shingle]]), ends[shingle - 1 :] - 1
    for k in range(0, len(starts), BLOCK):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())], "<u8")


def _bits_set(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each bit is set in runs of hashes that begin at `first`."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, first, axis=0, dtype=np.int64)


def fingerprint_batch(texts: list[str | None], shingle: int) -> np.ndarray:
    """SimHash of each text: a bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42).

    Bits are unpacked for about BLOCK shingles at once, of several texts or of a part of one.
    """
    ones, counts = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    waiting: list[tuple[int, np.ndarray]] = []
    total = 0

    def flush() -> None:
        nonlocal total
        if waiting:
            first = np.cumsum([0, *[len(h) for _, h in waiting[:-1]]])
            np.add.at(ones, [i for i, _ in waiting], _bits_set(np.concatenate([h for _, h in waiting]), first))
        waiting.clear()
        total = 0

    for i, text in enumerate(texts):
        for part in _shingle_hashes(text, shingle):
            waiting.append((i, part))
            counts[i] += len(part)
            total += len(part)
            if total >= BLOCK:
                flush()
    flush()
    return np.packbits(2 * ones > np.maximum(counts, 1)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and fp, its fingerprint as a signed long (no words: zero)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps, texts = [], part.column(1)
            for a in range(0, len(part), 500):
                fps.append(fingerprint_batch(texts.slice(a, 500).to_pylist(), shingle))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate([*fps, np.zeros(0, np.uint64)]).view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Covering:
    """Anchors for fingerprints that differ in at most `distance` bits.

    The bits are cut into blocks, so many that two linked fingerprints differ in at most one bit of some block.
    In each block the anchors are a covering code of radius 1: the words of a Hamming code over the first 2**r - 1
    bits, with every value of the other bits. A fingerprint's home is the anchor within the radius. It is replicated
    to every anchor within the radius plus that one bit, so it also comes to the home of each fingerprint linked to it.
    """

    RADIUS, WITHIN = 1, 1

    def __init__(self, distance: int):
        if not 0 <= distance < 16:
            raise ValueError("distance must be from 0 to 15")
        self.distance = distance
        blocks = distance // 2 + 1
        edges = [BITS * k // blocks for k in range(blocks + 1)]
        self.blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]

    @staticmethod
    def _syndrome(code: np.ndarray, n: int) -> np.ndarray:
        """The exclusive or of the places, from 1, of the bits that are set; zero for code words."""
        out = np.zeros(len(code), np.uint64)
        for place in range(n):
            out ^= ((code >> np.uint64(place)) & np.uint64(1)) * np.uint64(place + 1)
        return out

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, home): for each fingerprint all anchors that it goes to; home marks those within the radius."""
        rows, found, homes = [], [], []
        one, every = np.uint64(1), np.arange(len(fps))
        for k, (start, width) in enumerate(self.blocks):
            value = (fps >> np.uint64(start)) & np.uint64((1 << width) - 1)
            r = (width + 1).bit_length() - 1
            n = (1 << r) - 1
            syndrome = self._syndrome(value & np.uint64(n and (1 << n) - 1), n)
            flip = lambda x, at: x ^ np.where(at > 0, one << (np.maximum(at, one) - one), np.uint64(0))

            def add(mask: np.ndarray, anchor: np.ndarray, home: bool, k: int = k) -> None:
                rows.append(every[mask])
                found.append(anchor[mask] | np.uint64(k) << np.uint64(59))
                homes.append(np.full(int(mask.sum()), home))

            home = flip(value, syndrome)
            all_of = np.ones(len(fps), bool)
            add(all_of, home, True)
            for extra in range(n, width):  # one bit outside the code
                add(all_of, home ^ (one << np.uint64(extra)), False)
            for i in range(1, n + 1):  # two bits of the code: places i and i ^ syndrome
                i = np.uint64(i)
                j = syndrome ^ i
                add((syndrome > 0) & (i < j), flip(flip(value, np.full(len(fps), i)), j), False)
            if width - n > 1:  # two bits outside the code, where its part is itself a code word
                for p in range(n, width):
                    for q in range(p + 1, width):
                        add(syndrome == 0, value ^ (one << np.uint64(p)) ^ (one << np.uint64(q)), False)
        return np.concatenate(rows), np.concatenate(found), np.concatenate(homes)


def _replicate(covering: Covering):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(fps), 20_000):
                rows, found, homes = covering.anchors(fps[a : a + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(fps[a : a + 20_000][rows].view(np.int64)), pa.array(homes)], names=["anchor", "fp", "home"])

    return run


def _forest(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect a group just as all its links within distance do, but at most one for each member."""
    rest = fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                linked, rest = rest[near], rest[~near]
                frontier += list(linked)
                yield np.full(len(linked), x), linked


def _compare(distance: int):
    """Rows sorted by anchor to links within each anchor's group. A group may reach over batches."""

    def links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        sizes = np.diff(np.append(starts, len(anchor)))
        useful = (sizes > 1) & np.logical_or.reduceat(home, starts)
        out = []
        small = useful & (sizes <= SMALL)
        for size in np.unique(sizes[small]):
            group = fp[starts[small & (sizes == size)][:, None] + np.arange(size)]
            for i in range(size):
                for j in range(i + 1, size):
                    near = np.bitwise_count(group[:, i] ^ group[:, j]) <= distance
                    if near.any():
                        out.append((group[near, i], group[near, j]))
        for s, n in zip(starts[useful & ~small], sizes[useful & ~small]):
            out += _forest(fp[s : s + n], distance)
        return out

    def batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([*(f[k] for f in found), np.zeros(0, np.uint64)]) for k in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for part in parts:
            if not len(part):
                continue
            now = [part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64), part.column(2).to_numpy(zero_copy_only=False)]
            if kept and now[0][-1] == kept[-1][0][-1]:  # still the same group all through, or up to here
                kept.append(now)
                continue
            whole = [np.concatenate([k[c] for k in kept] + [now[c]]) for c in range(3)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield batch(links(*(c[:cut] for c in whole)))
            kept = [[c[cut:] for c in whole]]
        if kept:
            yield batch(links(*(np.concatenate([k[c] for k in kept]) for c in range(3))))

    return run


def near_links(distinct_fps: DataFrame, distance: int = 3) -> DataFrame:
    """fp (distinct) to links (a, b) that connect the same fingerprints as all pairs within distance do."""
    copies = distinct_fps.mapInArrow(_replicate(Covering(distance)), "anchor long, fp long, home boolean")
    return copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(distance), "a long, b long")


def _grouped(prints: DataFrame, distance: int) -> DataFrame:
    """prints (doc_id, fp, ...) with component_id.

    Copies meet in one distinct fingerprint before anything is compared, so the work at anchors depends on different
    fingerprints only, and there at most one link for each member is passed on.
    """
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct.select("fp"), distance))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(smallest, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id.

    Fingerprints link at `distance` or fewer differing bits; component_id is the smallest doc_id reachable, itself
    included (null only where all ids are). A null text has no words; texts without words have fingerprint zero and
    link like others. Repeated ids give repeated rows; an empty table gives an empty result.
    """
    grouped = _grouped(materialise(fingerprints(docs, shingle, id_col, text_col), "simhash"), distance)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, grouped: DataFrame, key: Column) -> DataFrame:
    """docs with the first row of each component; grouped (doc_id: key, id, n: rows of that key, component_id) is written already."""
    stays = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("first")).select(F.col("first.doc_id").alias("key"))
    goes = materialise(grouped.select(F.col("doc_id").alias("key")).join(stays, "key", "left_anti"), "dropped", stays=True)
    left = docs.select(F.struct("*").alias("doc"), key).join(goes, "key", "left_anti")
    if not grouped.filter("n > 1").isEmpty():
        left = left.dropDuplicates(["key"])
    return left.select("doc.*")
