"""Evaluation of translations against references: BLEU, chrF++, WER, TER and the paired bootstrap."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import words
from textloom.operators.edits import distances, edit_distance
from textloom.session import materialise

#: Fixed values of the published metrics.
BLEU_ORDER = 4
CHRF_CHARS, CHRF_WORDS, CHRF_BETA = 6, 2, 2.0
TER_SHIFT_WORDS, TER_SHIFT_DISTANCE = 10, 50


#: The ranges of characters that stand alone in Chinese text: ideographs, their parts, punctuation and full-width forms.
ALONE = (
    ("3400", "4DB5"), ("4E00", "9FA5"), ("9FA6", "9FBB"), ("F900", "FA2D"), ("FA30", "FA6A"), ("FA70", "FAD9"), ("20000", "2A6D6"), ("2F800", "2FA1D"),
    ("FF00", "FFEF"), ("2E80", "2EFF"), ("3000", "303F"), ("31C0", "31EF"), ("2F00", "2FDF"), ("2FF0", "2FFF"), ("3100", "312F"), ("31A0", "31BF"),
    ("FE10", "FE1F"), ("FE30", "FE4F"), ("2600", "26FF"), ("2700", "27BF"), ("3200", "32FF"), ("3300", "33FF"),
)
#: Entities that are decoded before the words are told apart, one after the other.
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def _apart(c: Column) -> Column:
    """Words, from which punctuation comes apart, but not in numbers."""
    out = F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), r"([\{-\~\[-\`\!-\&\(-\+\:-\@\/])", " $1 ")
    out = F.regexp_replace(out, r"([^0-9])([\.,])", "$1 $2 ")
    out = F.regexp_replace(out, r"([\.,])([^0-9])", " $1 $2")
    return words(F.regexp_replace(out, r"([0-9])(-)", "$1 $2 "))


def tokenize_13a(c: Column) -> Column:
    """The words of the usual BLEU tokenisation: entities are decoded, words broken at a line's end joined, punctuation comes apart."""
    out = F.replace(F.replace(F.replace(c, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return _apart(out)


def tokenize_zh(c: Column) -> Column:
    """Ideographs and their punctuation as words of their own; from the rest punctuation comes apart."""
    ranges = "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in ALONE)
    return _apart(F.regexp_replace(F.trim(c), f"([{ranges}])", " $1 "))


#: Words or characters that are counted together, so that what it takes stays small.
TOGETHER = 1 << 18


def _slices(lengths: np.ndarray, most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of rows of so many codes together, one row at least."""
    ends, i = np.cumsum(lengths), 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _ids(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in place of two arrays of words, the same for the same word."""
    codes = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes[: len(a)], codes[len(a) :]


#: (?U)\s of the JVM's patterns, and what Python and Arrow call white space besides.
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
NOT_SPACES = rb"[\x1c-\x1f]"
#: What comes apart in tokenize_13a(), and what may make a difference there.
APART = [(re.compile(a), b) for a, b in ((r"([{-~\[-`!-&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "), (SPACES, " "))]
MAY_PART = re.compile(r"[^ '0-9A-Za-z\xc0-\u167f\u3001-\U0010ffff]")

ENDS = frozenset("!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What words() gives, in a task: all words, and how many each text has; null has none."""
    if not _otherwise_split(texts):
        return _split(texts)
    lists = [[w for w in re.split(SPACES, t or "") if w] for t in texts.to_pylist()]
    return pa.array(list(chain.from_iterable(lists)), pa.large_string()), np.array([len(ws) for ws in lists], np.int64)


def _otherwise_split(texts: pa.Array) -> bool:
    return bool(re.search(NOT_SPACES, _bytes(texts.cast(pa.large_string()))[0]))


def split_13a(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What tokenize_13a() gives, in a task, as split_words().

    What is between two spaces decides on its own how it comes apart, so each different one is looked at once.
    """
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    parts = lists.flatten().dictionary_encode()
    apart = [_apart_13a(w) for w in parts.dictionary.to_pylist()]
    of, many = parts.indices.to_numpy(zero_copy_only=False), np.array([len(x) for x in apart], np.int64)
    n = many[of]
    at = np.repeat((np.cumsum(many) - many)[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return pa.array(list(chain.from_iterable(apart)), pa.large_string()).take(pa.array(at)), _sums_of(n, pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _apart_13a(w: str) -> list[str]:
    if not MAY_PART.search(w):
        return [w] if w else []
    # One mark at an end always comes apart from what has none; most words with marks are such.
    if w[-1] in ENDS and not MAY_PART.search(w, 0, len(w) - 1):
        return [w[:-1], w[-1]] if len(w) > 1 else [w]
    if w[0] in ENDS and not MAY_PART.search(w, 1):
        return [w[0], w[1:]]
    w = w.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in ENTITIES:
        w = w.replace(entity, char)
    w = f" {w} "
    for a, b in APART:
        w = a.sub(b, w)
    return [x for x in w.split(" ") if x]


Split = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def _lists(a: pa.Array, b: pa.Array, split: Split = split_words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words of two arrays of lists, or of texts that split() cuts into words, and the lengths of the lists; null is empty."""
    if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        codes = _ids(a.flatten(), b.flatten())
        n = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
        return codes[0], n[0], codes[1], n[1]
    # Both sides at once, as they have most words in common.
    found, n = split(pa.concat_arrays([a, b]))
    codes, first = found.dictionary_encode().indices.to_numpy(zero_copy_only=False), int(n[: len(a)].sum())
    return codes[:first], n[: len(a)], codes[first:], n[len(a) :]


def _bleu_sums(order: int, split: Split = split_words):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((order, 3), np.int64)
        for part in parts:
            sums += _gram_sums(*_lists(part.column(0), part.column(1), split), order)
        yield pa.RecordBatch.from_arrays([pa.array(range(1, order + 1), pa.int32()), *(pa.array(sums[:, k]) for k in range(3))], names=["n", "matches", "total", "ref_total"])

    return run


def bleu_counts(rows: DataFrame, hyp: Column, ref: Column, order: int = BLEU_ORDER, split: Split = split_words) -> DataFrame:
    """(n, matches, total, ref_total): clipped n-gram matches over all rows; hyp and ref are arrays of words, or texts that split() cuts into words.

    A row holds both sides, so its n-grams are counted where it is, and only sums are shuffled.
    """
    sums = rows.select(hyp.alias("hyp"), ref.alias("ref")).mapInArrow(_bleu_sums(order, split), "n int, matches long, total long, ref_total long")
    return sums.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("matches", "total", "ref_total")])


def corpus_bleu(rows: DataFrame, hyp: Column, ref: Column, order: int = BLEU_ORDER, split: Split = split_words) -> DataFrame:
    """One row: bleu (0 to 100), bp, sys_len, ref_len and precisions. Zero matches are smoothed by halving for each order that has none.

    Where an order has no n-grams at all, or nothing matches, the score is 0. Lengths are the numbers of single words.
    """
    return _bleu_of(bleu_counts(rows, hyp, ref, order, split), order)


def _bleu_of(counts: DataFrame, order: int) -> DataFrame:
    of = lambda c, n: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    sums = [of(c, n).alias(f"{n}_{c[0]}") for n in range(1, order + 1) for c in ("matches", "total")]
    row = counts.agg(*sums, of("total", 1).alias("sys_len"), of("ref_total", 1).alias("ref_len"))
    m = [F.col(f"{n}_m") for n in range(1, order + 1)]
    t = [F.col(f"{n}_t") for n in range(1, order + 1)]
    precisions, zeros = [], F.lit(0)
    for a, b in zip(m, t):
        zeros = zeros + F.when(a == 0, 1).otherwise(0)
        precisions.append(F.when(b == 0, F.lit(0.0)).when(a == 0, 100 / (F.pow(F.lit(2.0), zeros) * b)).otherwise(100.0 * a / b))
    bp = F.when(F.col("sys_len") >= F.col("ref_len"), 1.0).when(F.col("sys_len") > 0, F.exp(1 - F.col("ref_len") / F.col("sys_len"))).otherwise(0.0)
    logs = sum((F.ln(p) for p in precisions), F.lit(0.0))
    scored = F.when(F.greatest(*m) == 0, 0.0).when(F.least(*t) == 0, 0.0).otherwise(bp * F.exp(logs / order))
    return row.select(scored.alias("bleu"), bp.alias("bp"), "sys_len", "ref_len", F.array(*precisions).alias("precisions"))


def _gram_sums(hyp: np.ndarray, hyp_n: np.ndarray, ref: np.ndarray, ref_n: np.ndarray, order: int, referred: bool = False) -> np.ndarray:
    """Clipped matches and totals of both sides for the n-grams of each order; lists of codes lie one after the other.

    referred: a row's hypothesis counts only where its reference has n-grams of this order.
    """
    sums = np.zeros((order, 3), np.int64)
    hyp_at, ref_at = np.cumsum(hyp_n) - hyp_n, np.cumsum(ref_n) - ref_n
    for i, j in _slices(hyp_n + ref_n):
        here = [x[at[i] : at[j - 1] + n[j - 1]] for x, at, n in ((hyp, hyp_at, hyp_n), (ref, ref_at, ref_n))]
        sums += _gram_matches(here[0], hyp_n[i:j], here[1], ref_n[i:j], order, referred)
    return sums


def _gram_matches(hyp: np.ndarray, hyp_n: np.ndarray, ref: np.ndarray, ref_n: np.ndarray, order: int, referred: bool) -> np.ndarray:
    """_gram_sums() of some rows. n-grams that are alike on both sides are paired off, the longest first.

    Where two n-grams are alike, so are the shorter ones that they begin with, and a pair that is taken from both sides takes
    one from what matches. So shorter n-grams are looked at only where no longer one has been paired.
    """
    codes, n = np.concatenate([hyp, ref]).astype(np.uint64), np.concatenate([hyp_n, ref_n])
    rows = len(hyp_n)
    rest = np.repeat(np.cumsum(n), n) - np.arange(len(codes))
    row = np.repeat(np.tile(np.arange(rows, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 2), n)
    # Two codes are 64 bits.
    twos = codes.copy()
    twos[:-1] |= codes[1:] << np.uint64(32)
    out = np.zeros((order, 3), np.int64)
    pairs, left = 0, [np.zeros(0, np.int64)] * 2
    for k in range(order, 0, -1):
        # Places that haven't been paired, and those whose list ends too soon for longer n-grams.
        here = np.flatnonzero(rest >= k if k == order else rest == k)
        cut = int(np.searchsorted(here, len(hyp)))
        left = [np.concatenate([x, y]) for x, y in zip(left, (here[:cut], here[cut:]))]
        if k == order:
            every = _hashes(codes, twos, row, slice(None), k)
            grams = [every[at] for at in left]
        else:
            grams = [_hashes(codes, twos, row, at, k) for at in left]
        while len(grams[0]) and len(grams[1]):
            i, j = _pairs(*grams)
            pairs += len(i)
            stay = [np.ones(len(x), bool) for x in grams]
            stay[0][i] = stay[1][j] = False
            left, grams = ([x[y] for x, y in zip(side, stay)] for side in (left, grams))
            # Few pairs are left, or many n-grams that are the same.
            if 4 * len(i) < len(grams[0]):
                break
        totals = [np.maximum(x - k + 1, 0) for x in (hyp_n, ref_n)]
        out[k - 1] = pairs + _least(*grams), int((totals[0] * (totals[1] > 0)).sum() if referred else totals[0].sum()), int(totals[1].sum())
    return out


def _hashes(codes: np.ndarray, twos: np.ndarray, row: np.ndarray, at: np.ndarray | slice, k: int) -> np.ndarray:
    """A hash of the row and the k codes from each place on; of all places but the last k - 1 where a slice is given."""
    everywhere = isinstance(at, slice)
    h = row[: max(len(row) - k + 1, 0)].copy() if everywhere else row[at]
    for i in range(0, k, 2):
        taken = twos if i + 1 < k else codes
        h += taken[i : i + len(h)] if everywhere else taken[at + i]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xA24BAED4963EE407)
    return h


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the same values, none of them twice: the last of those in b that share the first bits, with one in a that has its value."""
    bits = max(len(b).bit_length() + 2, 8)
    shift = np.uint64(64 - bits)
    last = np.zeros(1 << bits, np.int32)
    last[b >> shift] = np.arange(len(b), dtype=np.int32)
    j = last[a >> shift]
    i = np.flatnonzero(b[j] == a)
    j = j[i]
    taken = np.zeros(len(b), np.int32)
    taken[j] = np.arange(len(j), dtype=np.int32)
    won = taken[j] == np.arange(len(j))
    return i[won], j[won]


def _least(a: np.ndarray, b: np.ndarray) -> int:
    """How many values both have, as often as the one that has it less often."""
    if not len(a) or not len(b):
        return 0
    one = np.uint64(1)
    keys = np.concatenate([a & ~one, b | one])
    keys.sort()
    cuts = np.flatnonzero(keys[1:] >> one != keys[:-1] >> one) + 1
    cuts = np.concatenate([[0], cuts, [len(keys)]])
    theirs = np.diff(np.concatenate([[0], np.cumsum(keys & one)]).astype(np.int64)[cuts])
    return int(np.minimum(theirs, np.diff(cuts) - theirs).sum())


def _chrf_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition: a row for each kind and n."""
    kinds = {"char": CHRF_CHARS, "word": CHRF_WORDS}
    sums = {kind: np.zeros((most, 3), np.int64) for kind, most in kinds.items()}
    for part in parts:
        lengths = sum(pc.fill_null(pc.utf8_length(part.column(k)), 0).to_numpy(zero_copy_only=False) for k in (0, 1))
        for i, j in _slices(lengths):
            sides = [_split(part.column(k).slice(i, j - i)) for k in (0, 1)]
            sums["char"] += _gram_sums(*_chars(*sides[0]), *_chars(*sides[1]), CHRF_CHARS, referred=True)
            hyp, ref = (_marks_apart(*side) for side in sides)
            codes = _ids(hyp[0], ref[0])
            sums["word"] += _gram_sums(codes[0], hyp[1], codes[1], ref[1], CHRF_WORDS, referred=True)
    keys = [(kind, n) for kind, most in kinds.items() for n in range(1, most + 1)]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([n for _, n in keys], pa.int32()), *(pa.array([int(sums[k][n - 1, c]) for k, n in keys], pa.int64()) for c in range(3))], names=["kind", "n", "matches", "hyp", "ref"])


def _word_lists(hyp: list[list[str]], ref: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_lists() of Python's lists."""
    codes = _ids(*(pa.array(list(chain.from_iterable(side)), pa.string()) for side in (hyp, ref)))
    n = [np.array([len(ws) for ws in side], np.int64) for side in (hyp, ref)]
    return codes[0], n[0], codes[1], n[1]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between white space of all texts, and how many each text has; null has none."""
    parts = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    found, n = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    # White space at an end leaves an empty word there.
    full = pc.greater(pc.binary_length(found), 0)
    return found.filter(full), _sums_of(full.to_numpy(zero_copy_only=False), n)


def _sums_of(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of each list of values; lists lie one after the other with these lengths."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[np.concatenate([[0], np.cumsum(n)])])


def _bytes(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What words are made of, one after the other, and where each begins, with the end."""
    ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    return np.frombuffer(found.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _chars(found: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each text's words, and how many there are."""
    return np.frombuffer(_bytes(found)[0].tobytes().decode().encode("utf-32-le"), "<u4"), _sums_of(pc.utf8_length(found).to_numpy(zero_copy_only=False), n)


#: ASCII punctuation.
MARKS = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


def _marks_apart(found: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words, from which one punctuation mark at the end, or else at the beginning, comes apart: it is only cut off where it is."""
    data, ends = _bytes(found)
    if not len(found):
        return found, n
    start, end = ends[:-1], ends[1:]
    long = end - start > 1
    last = long & MARKS[data[end - 1]]
    first = long & ~last & MARKS[data[start]]
    cuts = np.sort(np.concatenate([ends, end[last] - 1, start[first] + 1]), kind="stable")
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)), _sums_of(1 + (last | first), n)


def corpus_chrf(rows: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """One row: chrf, chrF++ of a corpus (0 to 100): the F-score, recall counting beta squared times, of mean precision and recall over n-gram orders.

    Rows are counted where they are, by arrays of hashes, and only sums are shuffled. A row's hypothesis counts
    for the orders of which its reference has n-grams; orders without n-grams on a side are left out.
    """
    sums = rows.select(hyp, ref).mapInArrow(_chrf_counts, "kind string, n int, matches long, hyp long, ref long").groupBy("kind", "n").agg(*[F.sum(c).alias(c) for c in ("matches", "hyp", "ref")])
    return _chrf_of(sums)


def _chrf_of(sums: DataFrame) -> DataFrame:
    used = sums.filter("hyp > 0 AND ref > 0")
    means = used.agg(F.avg(F.col("matches") / F.col("hyp")).alias("p"), F.avg(F.col("matches") / F.col("ref")).alias("r"))
    b2 = CHRF_BETA**2
    return means.select(F.coalesce(F.when(F.col("p") + F.col("r") > 0, 100 * (1 + b2) * F.col("p") * F.col("r") / (b2 * F.col("p") + F.col("r"))), F.lit(0.0)).alias("chrf"))


#: Words of the shorter side up to which pairs are compared together, by the bits of a number for each.
FEW_WORDS = 64


def _wer_sums(few: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a partition; a row without a side has no edits."""
        for part in parts:
            hyp, ref = (part.column(k) for k in (0, 1))
            both = pc.and_(pc.is_valid(hyp), pc.is_valid(ref)).to_numpy(zero_copy_only=False)
            lists = _lists(hyp, ref)
            edits = distances(*lists, few)
            yield _sums(int(edits[both].sum()) if both.any() else None, int(lists[3].sum()) if pc.is_valid(ref).true_count else None)

    return run


def _sums(edits: int | None, ref_words: int | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([edits], pa.int64()), pa.array([ref_words], pa.int64())], names=["edits", "ref_words"])


def corpus_wer(rows: DataFrame, hyp: Column, ref: Column) -> DataFrame:
    """One row: edits, ref_words and wer, edits in per cent of the references' words. hyp and ref are arrays of words, or texts, of any length.

    Rows are counted where they are, and only sums are shuffled.
    """
    sums = rows.select(hyp.alias("hyp"), ref.alias("ref")).mapInArrow(_wer_sums(FEW_WORDS), "edits long, ref_words long")
    return sums.agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words")).withColumn("wer", _rate())


def _rate() -> Column:
    return F.try_divide(F.col("edits") * 100.0, F.col("ref_words"))


def shifted_edits(hyp: list[str], ref: list[str], cost: int | None = None) -> int:
    """Edits with block shifts: while moving a run of words that the reference has elsewhere saves edits, the best move is made, at the cost of one.

    Of moves that save alike the shortest run counts, then the first. Moves that can't save more than the best one so far are
    passed over: a run of n words that moves by k saves at most twice the lesser of n and k.
    """
    now, moves = list(hyp), 0
    cost = edit_distance(now, ref) if cost is None else cost
    # Moves keep the words, so edits can't fall below those that one side has and the other hasn't.
    least = max(len(now), len(ref)) - sum((Counter(now) & Counter(ref)).values()) if cost > abs(len(now) - len(ref)) else cost
    while cost > least:
        saved, better = 0, None
        for n, i, j in _moves(now, ref):
            if 2 * min(n, abs(i - j)) <= saved:
                continue
            rest = now[:i] + now[i + n :]
            moved = rest[:j] + now[i : i + n] + rest[j:]
            by = cost - edit_distance(moved, ref)
            if by > saved:
                saved, better = by, moved
                if cost - saved == least:
                    break
        if better is None:
            break
        now, moves, cost = better, moves + 1, cost - saved
    return cost + moves


def _moves(now: list[str], ref: list[str]) -> Iterator[tuple[int, int, int]]:
    """(n, i, j): runs of n words at i that the reference has at j but not at i, shorter ones first."""
    for n in range(1, min(TER_SHIFT_WORDS, len(now)) + 1):
        at: dict[tuple, list[int]] = {}
        for j in range(len(ref) - n + 1):
            at.setdefault(tuple(ref[j : j + n]), []).append(j)
        for i in range(len(now) - n + 1):
            run = tuple(now[i : i + n])
            if run in at and tuple(ref[i : i + n]) != run:
                yield from ((n, i, j) for j in at[run] if abs(i - j) <= TER_SHIFT_DISTANCE)


def _ter_sums(few: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a partition; a text that is null has no words."""
        for part in parts:
            for i, j in _slices(np.ones(len(part), np.int64), 4096):
                texts = [part.column(k).slice(i, j - i) for k in (0, 1)]
                (hyp, hyp_n), (ref, ref_n) = (_split(x) for x in texts)
                codes = _ids(hyp, ref)
                edits = distances(codes[0], hyp_n, codes[1], ref_n, few)
                # Where more words differ than there are more or less, some may only have moved.
                for k in np.flatnonzero(edits > np.abs(hyp_n - ref_n)).tolist():
                    edits[k] = shifted_edits(*((x[k].as_py() or "").split() for x in texts), int(edits[k]))
                words_n = split_words(texts[1])[1] if _otherwise_split(texts[1]) else ref_n
                yield _sums(int(edits.sum()), int(words_n.sum()) if pc.is_valid(texts[1]).true_count else None)

    return run


def corpus_ter(rows: DataFrame, hyp: str = "hyp", ref: str = "ref", case: bool = False) -> DataFrame:
    """One row: edits with shifts, ref_words and ter, edits in per cent. Case counts only if asked for.

    Rows are counted where they are, and only sums are shuffled. Moves are looked for where edits are more than the words that a side has more.
    """
    h, r = (F.col(c) if case else F.lower(c) for c in (hyp, ref))
    sums = rows.select(h.alias("hyp"), r.alias("ref")).mapInArrow(_ter_sums(FEW_WORDS), "edits long, ref_words long")
    return sums.agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words")).withColumn("ter", _rate())


#: What evaluate() can give; the last two are means of scores that a caller's model has given the rows.
METRICS = ("bleu", "chrf", "ter", "wer", "comet", "bertscore")


def mean_scores(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: the mean of each column of scores over the rows that have one, null where none has."""
    return rows.agg(*[F.avg(c).alias(c) for c in columns])


def evaluate(rows: DataFrame, metrics: tuple[str, ...] = METRICS, hyp: str = "hyp", ref: str = "ref", tokenize: Callable[[Column], Column] = tokenize_13a) -> DataFrame:
    """One row with a column for each metric: those asked for whose columns are there, null for the others."""
    if set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(set(metrics) - set(METRICS))}")
    given = [m for m in ("comet", "bertscore") if m in metrics and m in rows.columns]
    h, r = F.col(hyp), F.col(ref)
    # Of each metric the columns that it takes, and its sums over some rows.
    parts = {
        "bleu": ([h, r], _bleu_sums(BLEU_ORDER, split_13a)) if tokenize is tokenize_13a else ([tokenize(h), tokenize(r)], _bleu_sums(BLEU_ORDER)),
        "chrf": ([h, r], _chrf_counts),
        "ter": ([F.lower(h), F.lower(r)], _ter_sums(FEW_WORDS)),
        "wer": ([h, r], _wer_sums(FEW_WORDS)),
    }
    parts = {name: part for name, part in parts.items() if name in metrics}
    columns = [c.alias(f"{name}{i}") for name, (taken, _) in parts.items() for i, c in enumerate(taken)]
    run = _all_sums({name: (len(taken), of) for name, (taken, of) in parts.items()}, given)
    found = rows.select(*columns, *[F.col(m).cast("double").alias(m) for m in given]).mapInArrow(run, "metric string, kind string, n int, a long, b long, c long, value double")
    # A few rows, whatever was read; texts are read once for all metrics.
    sums = materialise(found.groupBy("metric", "kind", "n").agg(*[F.sum(c).alias(c) for c in ("a", "b", "c", "value")]), "sums")
    of = lambda name, *names: sums.filter(F.col("metric") == name).select("kind", "n", *[F.col(x).alias(y) for x, y in zip("abc", names)])
    edits = lambda name: of(name, "edits", "ref_words").agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words")).select(_rate().alias(name))
    ends = {
        "bleu": lambda: _bleu_of(of("bleu", "matches", "total", "ref_total"), BLEU_ORDER).select("bleu"),
        "chrf": lambda: _chrf_of(of("chrf", "matches", "hyp", "ref")),
        "ter": lambda: edits("ter"),
        "wer": lambda: edits("wer"),
    }
    # Each part is one row.
    out = sums.agg(F.count("*").alias("__n"), *[F.try_divide(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.sum(F.when(F.col("metric") == m, F.col("a")))).alias(m) for m in given])
    for name in parts:
        out = out.crossJoin(F.broadcast(ends[name]()))
    return out.select(*[(F.col(m) if m in out.columns else F.lit(None).cast("double")).alias(m) for m in METRICS])


def _all_sums(parts: dict[str, tuple[int, Callable]], given: list[str]):
    """Sums of several metrics in one pass: each gets its columns of every batch. Of given scores the sum, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for name, (n, of) in parts.items():
                for sums in of(iter([pa.RecordBatch.from_arrays(batch.columns[at : at + n], names=batch.schema.names[at : at + n])])):
                    columns = {c: sums.column(c) for c in sums.schema.names}
                    kind, order = columns.pop("kind", pa.nulls(len(sums), pa.string())), columns.pop("n", pa.nulls(len(sums), pa.int32()))
                    longs = [*columns.values(), *[pa.nulls(len(sums), pa.int64())] * (3 - len(columns))]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums)), kind, order, *longs, pa.nulls(len(sums), pa.float64())], names=NAMES)
                at += n
            for m in given:
                x = batch.column(m)
                yield pa.RecordBatch.from_arrays([pa.array([m]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.array([len(x) - x.null_count], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([pc.sum(x).as_py()], pa.float64())], names=NAMES)

    return run


NAMES = ["metric", "kind", "n", "a", "b", "c", "value"]


def paired_bootstrap(scores: DataFrame, pos: str, a: str, b: str, replicates: int = 1000, mode: str = "standard", seed: int = 42) -> DataFrame:
    """One row: n, the mean difference b - a, and p.

    scores: a row for each sentence, pos from 1 to n. Draw k of replicate r is the row at a hash of both. p is the share
    of replicates whose difference is not above 0; with mode="centred" that at or above the observed one, which is
    near a half whatever the effect. Replicates take n rows each; poisson_bootstrap() is one pass for large n.
    """
    size = scores.agg(F.count("*").alias("n"), F.avg(F.col(b) - F.col(a)).alias("observed"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("k").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    draws = scores.select(F.col(pos).alias("k")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).crossJoin(F.broadcast(size))
    picked = draws.select("r", (h % F.col("n") + 1).alias(pos)).join(scores.select(pos, (F.col(b) - F.col(a)).alias("d")), pos)
    return _p_value(picked.groupBy("r").agg(F.avg("d").alias("d")), size, mode)


#: Positions of a block of split_bootstrap().
BOOTSTRAP_BLOCK = 1 << 16


def _draws_of(block: int, n: int, replicates: int, seed: int, width: int) -> np.ndarray:
    """How many of n draws, with replacement, fall into a block of positions, for each replicate.

    The draws are split between the halves of all blocks, and on between the halves of a half: a binomial number each, from
    a generator of the seed and the half. So every task finds the same numbers, which add up to n, with nothing but n.
    """
    low, high, draws = 0, -(-n // width), np.full(replicates, n, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        rows = [min(n, x * width) for x in (low, mid, high)]
        left = np.random.default_rng([seed, low, high]).binomial(draws, (rows[1] - rows[0]) / (rows[2] - rows[0]))
        low, high, draws = (low, mid, left) if block < mid else (mid, high, draws - left)
    return draws


def split_bootstrap(scores: DataFrame, pos: str, a: str, b: str, replicates: int = 1000, mode: str = "standard", seed: int = 42) -> DataFrame:
    """As paired_bootstrap(), one row of n, observed and p, in one pass: each replicate's draws are dealt out to blocks of positions.

    Whole replicates are exact: n draws with replacement, from generators that only the seed and the block decide. A block
    draws from its own rows, and gives a sum for each replicate, so nothing is joined and rows times replicates never exist as
    rows. pos is from 1 to n, without gaps. A null difference counts as 0.
    """
    rows = scores.select(F.col(pos).cast("long").alias("pos"), F.coalesce(F.col(b) - F.col(a), F.lit(0.0)).cast("double").alias("d"))
    size = rows.agg(F.count("*").alias("n"), F.avg("d").alias("observed"))
    n, width = size.first().n, BOOTSTRAP_BLOCK

    def sums(block: int, d: np.ndarray) -> pa.RecordBatch:
        draw = np.random.default_rng([seed, block, n, 1])
        found = [d[draw.integers(0, len(d), k)].sum() for k in _draws_of(block, n, replicates, seed, width).tolist()]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1)), pa.array(np.array(found, float))], names=["r", "s"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for part in parts:
            blocks = part.column(0).to_numpy()
            at = 0
            for cut in [*(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(part)]:
                if cut == at:
                    continue
                if kept and blocks[at] != now:
                    yield sums(int(now), np.concatenate(kept))
                    kept = []
                now = blocks[at]
                kept.append(part.column(1).to_numpy()[at:cut])
                at = cut
        if kept:
            yield sums(int(now), np.concatenate(kept))

    block = F.floor((F.col("pos") - 1) / width).cast("int").alias("block")
    dealt = rows.select(block, "pos", "d").repartition("block").sortWithinPartitions("block", "pos").select("block", "d")
    means = dealt.mapInArrow(run, "r long, s double").groupBy("r").agg((F.sum("s") / n if n else F.sum("s")).alias("d"))
    return _p_value(means, size, mode)


def poisson_bootstrap(scores: DataFrame, key: str, a: str, b: str, replicates: int = 1000, mode: str = "standard", seed: int = 42) -> DataFrame:
    """As paired_bootstrap(), but each row has a Poisson(1) weight in each replicate, from hashes: nothing is joined."""
    cuts, total, p = [], 0.0, float(np.exp(-1))
    for k in range(1, 12):
        total += p
        cuts.append(total)
        p /= k
    rows = scores.select(F.col(key).alias("key"), (F.col(b) - F.col(a)).alias("d"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r"))
    u = F.pmod(F.xxhash64("key", "r", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    means = rows.withColumn("w", weight).groupBy("r").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("d"))
    size = scores.agg(F.count("*").alias("n"), F.avg(F.col(b) - F.col(a)).alias("observed"))
    return _p_value(means, size, mode)


def _p_value(means: DataFrame, size: DataFrame, mode: str) -> DataFrame:
    if mode not in ("standard", "centred"):
        raise ValueError(f"unknown mode {mode}")
    at = F.col("d") <= 0 if mode == "standard" else F.col("d") >= F.col("observed")
    return means.crossJoin(F.broadcast(size)).groupBy("n", "observed").agg(F.avg(at.cast("int")).alias("p"))


def target_flags(bleu: Column, comet: Column | None = None) -> Column:
    """Whether the quality targets are met: BLEU of 30, COMET of 0.8; a score that is missing doesn't count."""
    out = F.coalesce(bleu >= 30, F.lit(True))
    return out if comet is None else out & F.coalesce(comet >= 0.8, F.lit(True))
