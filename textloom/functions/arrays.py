"""Array functions as Column builders: n-grams, vectors, padding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an expression inside a lambda is evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def ngrams(items: Column, n: int) -> Column:
    """All runs of n items, as arrays; none where there are fewer."""

    def runs(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(x) - n, F.lit(0)))
        # Single items cost nothing to reach; slice() copies the whole array each time.
        return F.when(F.size(x) >= n, F.transform(starts, lambda i: F.array(*[F.get(x, i + k) for k in range(n)]))).otherwise(F.array().cast("array<array<string>>"))

    return bound(items, runs)


def repeat_ratio(items: Column, n: int = 3) -> Column:
    """1 - distinct n-grams / n-grams; 0 where there are none. items: strings without line ends, or single characters.

    Joined to strings, as distinct arrays of arrays are found by comparing all pairs.
    """
    grams = F.transform(ngrams(items, n), lambda g: F.array_join(g, "\n"))
    return bound(grams, lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """Cut or filled up to a fixed length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention_mask(ids: Column, length: int) -> Column:
    """1 for real positions of padded(), 0 for filled ones."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= F.size(ids)).cast("int"))


def labels(ids: Column, length: int, ignore: int = -100) -> Column:
    """padded() with positions that are filled marked to be ignored by a loss."""
    return padded(ids, length, ignore)


def oov_ratio(text: Column, vocabulary: list[str] | None) -> Column:
    """Share of characters, with repeats, that aren't in the vocabulary; 0 without one."""
    if not vocabulary:
        return F.lit(0.0)
    known = F.array(*[F.lit(v) for v in vocabulary])
    chars = F.split(text, "")
    missing = F.size(F.filter(chars, lambda c: ~F.array_contains(known, c)))
    return F.when(F.length(text) > 0, missing / F.length(text)).otherwise(0.0)


def int4(x: Column, low: Column, high: Column) -> Column:
    """Affine quantisation to -8..7 over [low, high], rounding half to even; a constant range maps to -8."""
    scale = (high - low) / 15
    return F.when(scale > 0, F.greatest(F.least(F.bround(x / scale + (-8 - low / scale)), F.lit(7.0)), F.lit(-8.0))).otherwise(F.lit(-8.0)).cast("int")


def smoothed_cross_entropy(log_probs: Column, target: Column, pad: int = 0, epsilon: float = 0.1) -> Column:
    """Label-smoothing loss of a token: -sum q * log p, q being 1 - epsilon at the target, 0 at pad, else epsilon / (V - 2)."""
    v = F.size(log_probs)
    rest = F.lit(epsilon) / (v - 2)
    return -F.aggregate(
        F.transform(log_probs, lambda x, i: x * F.when(i == target, F.lit(1 - epsilon)).when(i == pad, F.lit(0.0)).otherwise(rest)),
        F.lit(0.0),
        lambda s, x: s + x,
    )
