"""Toxicity: a linear classifier that is penalised when swapping identity terms changes its score."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._text import small_batches
from textloom.session import materialise

#: Identity terms by language. Within a list any two may take each other's place in a sentence.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "athées"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "atheisten"],
    ["mujeres", "hombres", "chicas", "chicos"],
    ["musulmanes", "cristianos", "judíos", "ateos"],
]
_PLACE = {term: (group, k) for group in IDENTITY_TERMS for k, term in enumerate(group)}
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows to learn from, at most (those with the least hashes of their id). Words and word beginnings that
    set toxic and other rows of the sample apart by least_z standard errors are features, and all identity terms. swaps:
    counterfactuals of a row with another term, beside the one without a term. fairness weighs the squared change of a
    score between them, ridge the squared weights. The fit ends when no derivative is more than tolerance, or after steps."""

    sample: int = 20_000
    least_z: float = 4.0
    swaps: int = 3
    fairness: float = 5.0
    ridge: float = 1e-5
    steps: int = 600
    tolerance: float = 1e-6


#: Tasks that the bounded sample is dealt out to.
SAMPLE_PARTS = 32
#: Lengths of the word beginnings that are features beside whole words; they hold what inflected and compound words share.
PREFIXES = (4, 5)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(found: set[str]) -> set[str]:
    """The words, and as "beginning-" those of longer words."""
    return found.union(*[{f"{w[:n]}-" for w in found if len(w) > n} for n in PREFIXES])


class Vocabulary:
    """The features that a model knows; remembers which of them each word has."""

    def __init__(self, known: set[str]):
        self.known, self.memo = known, {}

    def of(self, found: set[str]) -> set[str]:
        memo, out = self.memo, set()
        for w in found:
            own = memo.get(w)
            if own is None:
                if len(memo) > 300_000:
                    memo.clear()
                own = memo[w] = frozenset(features({w}) & self.known)
            if own:
                out |= own
        return out


def counterfactuals(found: set[str], swaps: int) -> tuple[set[str], list[set[str]]]:
    """The words of a sentence with identity terms, and those of the same sentence with others in their place, or none.

    A sentence without any gets one put in: which one, its words say. Each term gives way to `swaps` others of its list.
    """
    mentioned = found & _PLACE.keys()
    if not mentioned:
        h = zlib.crc32(" ".join(sorted(found)).encode())
        group = IDENTITY_TERMS[h % len(IDENTITY_TERMS)]
        mentioned = {group[h // len(IDENTITY_TERMS) % len(group)]}
    rest = found - mentioned
    other = lambda w, j: _PLACE[w][0][(_PLACE[w][1] + j) % len(_PLACE[w][0])]
    return rest | mentioned, [rest, *(rest | {other(w, j) for w in mentioned} for j in range(1, swaps + 1))]


@dataclass(frozen=True)
class Model:
    """affected: of the rows learnt from, those of which a swap changes the features; slope: the largest derivative left by the fit."""

    bias: float
    weights: dict[str, float]
    affected: int = 0
    slope: float = 0.0

    def score(self, text: str | None, vocabulary: Vocabulary | None = None) -> float:
        own = (vocabulary or Vocabulary(set(self.weights))).of(words(text))
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum([self.weights[f] for f in sorted(own)]), -50, 50))))


class Sparse:
    """A matrix of few values: lists of columns for each row, or of (column + 1) with the value's sign, and a scale for each column."""

    def __init__(self, rows: list, scale: np.ndarray):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.concatenate([np.zeros(0, np.int64), *map(np.asarray, rows)]).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        self.n, self.scale, self.row, self.col = len(rows), scale, np.repeat(np.arange(len(rows)), sizes), np.abs(at) - 1
        self.value = np.sign(at) * scale[self.col]

    def times(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * u[self.col], self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * e[self.row], len(self.scale))

    def squares(self) -> float:
        return float((self.value**2).sum()) / max(self.n, 1)


#: Steps that the fit remembers, to tell the curvature of what it minimises.
REMEMBERED = 12


def fit(rows: Sparse, changes: Sparse, label: np.ndarray, s: Settings) -> tuple[float, np.ndarray, float]:
    """Logistic regression on 0/1 features; changes: what a swap of identity terms does to a row's features.

    Minimises the mean log loss, plus fairness times the mean squared change of a score (before the logistic
    function) and ridge times the squared weights, by limited-memory quasi-Newton steps. Returns the bias, the weights and the largest
    derivative that is left.
    """
    n, m = max(rows.n, 1), max(changes.n, 1)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, z = x[:-1], rows.times(x[:-1]) + x[-1]
        moved = changes.times(w)
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) / n
        value = float((np.logaddexp(0, z) - label * z).sum()) / n + s.fairness * float(moved @ moved) / m + s.ridge * float(w @ w)
        return value, np.append(rows.back(e) + 2 * s.fairness * changes.back(moved) / m + 2 * s.ridge * w, e.sum())

    x = np.zeros(len(rows.scale) + 1)
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(s.steps):
        if np.abs(slope).max() <= s.tolerance:
            break
        way, shares = -slope, []
        for dx, dg, rho in reversed(past):
            shares.append(rho * (dx @ way))
            way = way - shares[-1] * dg
        way = way * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else min(1.0, 1 / np.abs(slope).sum()))
        for (dx, dg, rho), share in zip(past, reversed(shares)):
            way = way + (share - rho * (dg @ way)) * dx
        step, down = 1.0, float(slope @ way)
        while True:
            x2 = x + step * way
            value2, slope2 = loss(x2)
            if value2 <= value + 1e-4 * step * down or step < 1e-10:
                break
            step /= 2
        dx, dg = x2 - x, slope2 - slope
        bend = float(dx @ dg)
        if bend > 0:
            past = [*past[1 - REMEMBERED :], (dx, dg, 1 / bend)]
        elif step < 1e-10:
            break
        x, value, slope = x2, value2, slope2
    return float(x[-1]), x[:-1], float(np.abs(slope).max())


def held_out(id_column: Column) -> Column:
    """One id in five, by the CRC-32 of its digits; never used for learning."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the labelled rows that aren't held out.

    Of several labels of an id the largest counts; rows without an id or label are left out. Without labelled
    rows, or with one class only, the model knows no words. A document that repeats with its id counts each time; texts
    may be null or empty. What goes to the driver is bounded by the sample: the chosen ids, the features that set its rows
    apart, and for each row its places among them.
    """
    small_batches(docs)
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    chosen = y.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialise(slim.join(F.broadcast(chosen), "doc_id").select("y", "text", "doc_id").repartition(SAMPLE_PARTS), "labelled")
    sizes = dict(rows.groupBy(F.col("y") > 0).count().collect())
    positive, negative = sizes.get(True, 0), sizes.get(False, 0)
    if not positive or not negative:
        return Model(50.0 if positive else -50.0 if negative else 0.0, {})

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for part in parts:
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen[label > 0].update(features(words(text)))
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([c[w] for w in both], pa.int64()) for c in seen)], names=["word", "n0", "n1"])

    a, b, share = F.col("n1") / positive, F.col("n0") / negative, (F.col("n0") + F.col("n1")) / (positive + negative)
    z = (a - b) / F.sqrt(share * (1 - share) * (1 / positive + 1 / negative))
    counts = rows.mapInArrow(spread, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    apart = counts.filter((share < 1) & ~F.col("word").isin(list(_PLACE))).select("word", F.abs(z).alias("z")).filter(F.col("z") >= s.least_z)
    strong = {r.word: r.z for r in apart.collect()}
    vocabulary = sorted(strong) + sorted(_PLACE)
    # The ridge holds back most what is least sure.
    scale = np.array([strong.get(w, s.least_z) / max(strong.values(), default=1.0) for w in vocabulary])
    place = {w: i for i, w in enumerate(vocabulary)}

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(set(place))
        at = lambda found: {place[f] + 1 for f in known.of(found)}
        for part in parts:
            own, named, changes = [], [], []
            for text in part.column(1).to_pylist():
                found = words(text)
                mentions, others = counterfactuals(found, s.swaps)
                before = at(mentions)
                moves = [[*(after - before), *(-i for i in before - after)] for after in map(at, others)]
                own.append(sorted(at(found)))
                named.append(sorted(before))
                changes.append([sorted(x) for x in moves if x])
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (own, named)), pa.array(changes, pa.list_(pa.list_(pa.int32()))), part.column(2)], names=["y", "x", "named", "changes", "doc_id"])

    sample = rows.mapInArrow(placed, "y int, x array<int>, named array<int>, changes array<array<int>>, doc_id long").toPandas()
    # One order, so that sums and with them scores are the same on every run.
    sample = sample.iloc[sorted(range(len(sample)), key=lambda i: (sample["doc_id"].iat[i], [*sample["x"].iat[i]], [*sample["named"].iat[i]]))]
    changes = [x for row in sample["changes"] for x in row]
    # Each sentence is learnt from as it is and with a term, so a term that happens to go with a label gets a weight, unless the penalty holds it back.
    label = (sample["y"].to_numpy() > 0).astype(float)
    bias, weights, slope = fit(Sparse([*sample["x"], *sample["named"]], scale), Sparse(changes, scale), np.concatenate([label, label]), s)
    return Model(bias, {w: float(x) for w, x in zip(vocabulary, weights * scale) if x}, sum(len(x) > 0 for x in sample["changes"]), slope)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on).

    A null or empty text scores as the bias alone, and a row with a null id is never held out. Rows are independent: repeated
    ones repeat their score, and an empty table gives an empty result.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(set(model.weights))
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(t, known) for t in part.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    small_batches(docs)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
