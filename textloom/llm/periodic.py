"""Periodic runs of words: partition refinement of equal factors, squares of neighbouring members, and runs merged from them.

Positions of a text are in one class when the words from there on are equal for a length; classes are refined length
by length. Of the parts into which a class falls all but the largest refine the next length, so a position is moved at
most log2(n) times. Members of a class that are neighbours and as far apart as the length are a square with a primitive
root, and squares of one period that start at consecutive words are one run. All texts of a block are refined at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._text import Words, _mixed, batches, rolling, small_batches

#: Bytes of text that are refined at once; a longer text is a block of its own, and takes some 100 bytes of memory a word.
BLOCK = 6 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all ranges [begin, begin + size), one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


class Classes:
    """Positions by equal factors of a length, which refine() makes longer by one.

    of: the class of each position; order: positions with those of a class side by side, of which `begin` and `size` are
    by class; at: the place of each position in order; following, preceding: its neighbours within the class, by position.
    """

    def __init__(self, factor: np.ndarray):
        """factor: a number for each position, equal for equal factors."""
        n = len(factor)
        _, self.of, size = np.unique(factor, return_inverse=True, return_counts=True)
        self.count = len(size)
        self.size, self.begin = (np.zeros(2 * n + 2, np.int64) for _ in range(2))
        self.size[: self.count] = size
        self.begin[: self.count] = np.cumsum(size) - size
        self.order = np.argsort(self.of, kind="stable")
        self.at = np.empty(n, np.int64)
        self.at[self.order] = np.arange(n)
        self.following, self.preceding = np.full(n, -1), np.full(n, -1)
        self._moved = np.zeros(n, bool)
        same = self.of[self.order[1:]] == self.of[self.order[:-1]]
        self._link(self.order[:-1][same], self.order[1:][same])

    def _link(self, left: np.ndarray, right: np.ndarray) -> None:
        self.following[left], self.preceding[right] = right, left

    def _new(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        ids = np.arange(self.count, self.count + len(size))
        self.count += len(size)
        while self.count > len(self.size):
            self.size, self.begin = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.begin))
        self.size[ids], self.begin[ids] = size, begin
        return ids

    def refine(self, moved: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split classes by the class `by` of what follows each moved position; positions that aren't moved have one in common.

        moved is ascending, without positions that are alone in their class. Returns the positions of all parts but the
        largest of each class, ascending, and the positions whose next neighbour is another one.
        """
        old = self.of[moved]
        by_class = np.argsort(old, kind="stable")
        changed = [self._unlink(moved[by_class], old[by_class])]
        sorted_ = np.argsort(old * np.int64(self.count) + by, kind="stable")
        moved, old, by = moved[sorted_], old[sorted_], by[sorted_]
        new_class = np.concatenate([[True], old[1:] != old[:-1]])
        new_part = new_class | np.concatenate([[True], by[1:] != by[:-1]])
        parts, firsts = np.flatnonzero(new_part), np.flatnonzero(new_class)
        sizes, class_of_part = np.diff(parts, append=len(moved)), old[parts]
        totals, touched = np.diff(firsts, append=len(moved)), old[firsts]
        rest = self.size[touched] - totals
        # Moved positions go to the front of their class, part by part.
        begin = self.begin[touched]
        slots = _ranges(begin, totals)
        self._moved[moved] = True
        front = self.order[slots]
        staying = front[~self._moved[front]]
        vacant = self.at[moved][self.at[moved] >= np.repeat(begin + totals, totals)]
        self._moved[moved] = False
        self.order[vacant], self.at[staying] = staying, vacant
        self.order[slots], self.at[moved] = moved, slots
        # The rest of a class keeps its number; where there is none, the largest part does.
        first_part = np.searchsorted(parts, firsts)
        largest = np.maximum.reduceat(sizes, first_part)
        index = np.repeat(np.arange(len(firsts)), np.diff(first_part, append=len(parts)))
        is_largest = sizes == largest[index]
        is_largest &= np.cumsum(is_largest) - np.repeat((np.cumsum(is_largest) - is_largest)[first_part], np.diff(first_part, append=len(parts))) == 1
        keeps = is_largest & (rest == 0)[index]
        starts = slots[parts]
        self.begin[touched], self.size[touched] = begin + totals, rest
        kept = class_of_part[keeps]
        self.begin[kept], self.size[kept] = starts[keeps], sizes[keeps]
        ids = np.where(keeps, class_of_part, 0)
        ids[~keeps] = self._new(starts[~keeps], sizes[~keeps])
        self.of[moved] = np.repeat(ids, sizes)
        # Neighbours within the parts.
        inner = ~new_part[1:]
        left, right = moved[:-1][inner], moved[1:][inner]
        differs = self.following[left] != right
        changed.append(left[differs])
        ends = np.append(parts[1:], len(moved)) - 1
        self._link(left, right)
        self.preceding[moved[parts]], self.following[moved[ends]] = -1, -1
        # All but the largest part of each class, the rest being one.
        small_part = ~(is_largest & (largest > rest)[index])
        small_rest = (rest > 0) & (rest < largest)
        splitters = [moved[np.repeat(small_part, sizes)], self.order[_ranges((begin + totals)[small_rest], rest[small_rest])]]
        return np.sort(np.concatenate(splitters)), np.concatenate(changed)

    def _unlink(self, moved: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Take positions, sorted within their class, out of its list; returns those that get another next neighbour."""
        joined = (old[1:] == old[:-1]) & (self.following[moved[:-1]] == moved[1:])
        left = self.preceding[moved[np.concatenate([[True], ~joined])]]
        right = self.following[moved[np.concatenate([~joined, [True]])]]
        both = (left >= 0) & (right >= 0)
        self.following[left[left >= 0]] = right[left >= 0]
        self.preceding[right[right >= 0]] = left[right >= 0]
        return left[both]


def word_runs(words: np.ndarray, first: np.ndarray, least: int = 24, power: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in several texts, by start and period.

    words: a hash for each word; first: where each text starts, with the number of words at the end. A run is a maximal
    stretch with smallest period q and at least max(least, power * q) words, power from 2 on. Refinement begins at the length
    least // power: all periods up to there show in it, as no shorter run counts, and each longer one at its own length.
    """
    base, nothing = max(1, least // power), np.zeros(0, np.int64)
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    here = np.arange(len(words))
    whole = here + base <= first[1:][document]
    places, factors = here[whole], rolling(words, base)
    factors = _mixed(factors[places] ^ _mixed(document[places].astype(np.uint64) + np.uint64(1)))
    # Texts in which no factor of this length is found twice have no run.
    ordered = np.argsort(factors, kind="stable")
    twice = factors[ordered[1:]] == factors[ordered[:-1]]
    busy = np.zeros(len(first) - 1, bool)
    busy[document[places[ordered[1:][twice]]]] = True
    position = np.flatnonzero(busy[document])
    if not len(position):
        return nothing, nothing, nothing
    n = len(position)
    factor = np.arange(n, dtype=np.int64)  # what is cut off by the end of its text is equal to nothing
    inside = whole[position]
    known = np.unique(factors[busy[document[places]]], return_inverse=True)[1]
    factor[inside] = n + known
    classes = Classes(factor)
    text = document[position]
    longest = (np.diff(first) // power)[text]
    opens = np.concatenate([[True], text[1:] != text[:-1]])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pending: dict[int, list[np.ndarray]] = defaultdict(list)

    def note(left: np.ndarray, length: int) -> None:
        """Keep pairs of neighbours until classes have come to the length of their distance."""
        apart = classes.following[left] - left
        use = (classes.following[left] >= 0) & (apart >= length) & (apart <= longest[left])
        left, apart = left[use], apart[use]
        by = np.argsort(apart, kind="stable")
        left, apart = left[by], apart[by]
        cuts = np.flatnonzero(np.concatenate([[True], apart[1:] != apart[:-1]])) if len(apart) else nothing
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(apart)]):
            pending[int(apart[a])].append(left[a:b])

    def merge(period: int, length: int) -> None:
        """Squares of one period that start at consecutive words are a run."""
        at = pending.pop(period, None)
        if at is None:
            return
        at = np.unique(np.concatenate(at))
        at = at[classes.following[at] == at + period]
        if not len(at):
            return
        breaks = np.flatnonzero(np.diff(at) != 1)
        starts, ends = at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)]
        lengths = ends - starts + length + period
        long_ = lengths >= max(least, power * period)
        if long_.any():
            found.append((position[starts[long_]], lengths[long_], np.full(int(long_.sum()), period)))

    note(np.flatnonzero(classes.following >= 0), 1)
    for period in range(1, base + 1):
        merge(period, base)
    splitters, length, last = np.arange(n), base, int(longest.max())
    while len(splitters) and length < last:
        before = splitters[~opens[splitters]] - 1
        before = before[classes.size[classes.of[before]] > 1]
        length += 1
        if not len(before):
            break
        splitters, changed = classes.refine(before, classes.of[before + 1])
        note(changed, length)
        merge(length, length)
    if not found:
        return nothing, nothing, nothing
    start, size, period = (np.concatenate(c) for c in zip(*found))
    by = np.lexsort((period, start))
    return start[by], size[by], period[by]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, exactly; of equal ones the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _collapsed(texts: pa.Array, least: int, power: int) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """For each text its runs, and its words without those that a run repeats, joined by one space."""
    words = Words(texts)
    start, length, period = word_runs(words.hashes(), words.first, least, power)
    cuts = np.searchsorted(start, words.first)
    for k, text in enumerate(texts.to_pylist()):
        own = (text or "").encode().split()  # at the same six bytes as Words
        a, b = cuts[k], cuts[k + 1]
        runs = list(zip((start[a:b] - words.first[k]).tolist(), length[a:b].tolist(), period[a:b].tolist()))
        if runs:
            depth = np.zeros(len(own) + 1, np.int64)
            for s, n, q in runs:
                depth[s + q] += 1
                depth[s + n] -= 1
            gone = np.cumsum(depth) > 0
            own = [w for w, g in zip(own, gone.tolist()) if not g]
        yield runs, b" ".join(own).decode()


def collapse_runs(docs: DataFrame, least: int = 24, power: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, runs (array of start, length, period; by start, then period), strongest (one of them) and collapsed.

    A run is a maximal stretch of words with smallest period q and at least max(least, power * q) words. strongest has
    the greatest length / period (ties: smallest start, then period), null where there is no run. collapsed are the words that no
    run has after its first q words, joined by one space. Words are maximal runs of bytes but ASCII white space, taken as
    they are; a null, empty or blank text has none and gives no run and an empty text. Repeated rows give repeated rows,
    an empty table gives an empty one. Texts are worked on where they are, without a shuffle.
    """
    if power < 2 or least < power:
        raise ValueError("power must be 2 or more and least must not be smaller")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for part in parts:
            for a, b in batches(part.column(1), BLOCK):
                rows = list(_collapsed(part.column(1).slice(a, b - a), least, power))
                as_dict = lambda r: r and dict(zip(("start", "length", "period"), r))
                runs = pa.array([[as_dict(r) for r in found] for found, _ in rows], kind)
                best = pa.array([as_dict(_strongest(found)) for found, _ in rows], kind.value_type)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), runs, best, pa.array([t for _, t in rows], pa.string())], names=["doc_id", "runs", "strongest", "collapsed"])

    small_batches(docs, rows=4000)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, runs {RUNS}, strongest {RUNS[6:-1]}, collapsed string")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, in which a tenth of the texts, by CRC-32 of the id, repeat p words from word a on to their end.

    h is the CRC-32 of the decimal id and g = floor(h / 10). Where h % 10 = 0 and the text has n > 0 words, a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)), and word i from a on is word a + (i - a) % p. Others, also those without an id, stay.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # The words are bound as the element of an array, so that they are found once and not for each of them.
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), 0)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(h % 10 == 0, F.coalesce(planted, F.col(text_col))).otherwise(F.col(text_col)).alias("text"))


def audited(docs: DataFrame) -> DataFrame:
    """The digests that the query returns: doc_id, n_runs, the strongest run, and hashes of all runs and of what is left."""
    best = lambda c: F.col(f"strongest.{c}").alias(c)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    sha = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    return docs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best("start"), best("length"), best("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), sha(F.array_join(lines, ""), "runs_sha256"), sha(F.col("collapsed"), "collapsed_sha256"))
