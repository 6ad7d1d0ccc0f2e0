"""Edit distances of lists of words: many short pairs at once as bits of 64-bit numbers, longer ones as bits of whole numbers."""

from __future__ import annotations

import numpy as np

#: Pairs that are done together, so that what they need stays small.
TOGETHER = 4096


def common(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """How many codes are alike from a_at in a and b_at in b on, at most `most`, for each pair; step -1 goes backwards."""
    found = np.zeros(len(most), np.int64)
    left = np.flatnonzero(most > 0)
    k = 0
    while len(left):
        left = left[a[a_at[left] + step * k] == b[b_at[left] + step * k]]
        k += 1
        found[left] = k
        left = left[most[left] > k]
    return found


def alike(a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common beginning and end of each pair of lists, which don't overlap; lists lie one after the other."""
    a_end, b_end, most = np.cumsum(a_n), np.cumsum(b_n), np.minimum(a_n, b_n)
    start = common(a, a_end - a_n, b, b_end - b_n, most)
    return start, common(a, a_end - 1, b, b_end - 1, most - start, -1)


def distances(a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray, few: int = 64) -> np.ndarray:
    """Edits of each pair of lists of codes, which lie one after the other with these lengths.

    few: how long the shorter list may be, without what both begin and end with, to be done together with others; 64 at most.
    """
    start, end = alike(a, a_n, b, b_n)
    a_at, b_at = np.cumsum(a_n) - a_n + start, np.cumsum(b_n) - b_n + start
    a_n, b_n = a_n - start - end, b_n - start - end
    out = np.maximum(a_n, b_n)
    open_ = np.minimum(a_n, b_n) > 0
    short = open_ & (np.minimum(a_n, b_n) <= min(few, 64))
    for i in np.flatnonzero(open_ & ~short).tolist():
        out[i] = _distance(a[a_at[i] : a_at[i] + a_n[i]].tolist(), b[b_at[i] : b_at[i] + b_n[i]].tolist())
    rows = np.flatnonzero(short)
    rows = rows[np.argsort(-out[rows], kind="stable")]
    codes = np.concatenate([a, b])
    for k in range(0, len(rows), TOGETHER):
        part = rows[k : k + TOGETHER]
        turned = a_n[part] < b_n[part]
        here, there = a_at[part], b_at[part] + len(a)
        # The shorter list is the pattern.
        lengths = np.minimum(a_n[part], b_n[part]), np.maximum(a_n[part], b_n[part])
        out[part] = _together(codes, np.where(turned, here, there), lengths[0], np.where(turned, there, here), lengths[1])
    return out


def _together(codes: np.ndarray, p_at: np.ndarray, p_n: np.ndarray, t_at: np.ndarray, t_n: np.ndarray) -> np.ndarray:
    """Edits of patterns of 1 to 64 codes and texts, the longest text first: each step takes the next code of every text."""
    wide = int(p_n.max())
    places = np.arange(wide)
    pattern = np.where(places < p_n[:, None], codes[np.minimum(p_at[:, None] + places, len(codes) - 1)], -1)
    found = np.zeros((len(p_n), 64), bool)
    one = np.uint64(1)
    top, score = (p_n - 1).astype(np.uint64), p_n.copy()
    up, down = np.full(len(p_n), ~np.uint64(0)), np.zeros(len(p_n), np.uint64)
    for k in range(int(t_n[0])):
        n = int(np.searchsorted(-t_n, -k, "left"))
        np.equal(pattern[:n], codes[t_at[:n] + k][:, None], out=found[:n, :wide])
        same = np.packbits(found[:n], axis=1, bitorder="little").view(np.uint64)[:, 0]
        u, d = up[:n], down[:n]
        x = same | d
        across = (((same & u) + u) ^ u) | same
        more = d | ~(across | u)
        less = u & across
        score[:n] += (more >> top[:n] & one).astype(np.int64) - (less >> top[:n] & one).astype(np.int64)
        more = more << one | one
        up[:n] = less << one | ~(x | more)
        down[:n] = more & x
    return score


def _distance(a: list, b: list) -> int:
    """Edits of two lists that aren't empty: a column of the table of distances as bits of two numbers, for any length."""
    if len(a) < len(b):
        a, b = b, a
    left = iter(a)
    # All of the shorter list in its order in the longer one: edits are the words between.
    if all(w in left for w in b):
        return len(a) - len(b)
    at: dict = {}
    for i, w in enumerate(b):
        at.setdefault(w, []).append(i)
    bits = {}
    for w, places in at.items():
        # Few places are set one by one, many by way of bytes.
        if len(places) < 8:
            bits[w] = sum(1 << i for i in places)
        else:
            mask = np.zeros(len(b), np.uint8)
            mask[places] = 1
            bits[w] = int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")
    full, top = (1 << len(b)) - 1, len(b) - 1
    up, down, score = full, 0, len(b)
    for w in a:
        same = bits.get(w, 0)
        x = same | down
        across = (((same & up) + up) ^ up) | same
        more = down | (full & ~(across | up))
        less = up & across
        score += (more >> top & 1) - (less >> top & 1)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up = less | (full & ~(x | more))
        down = more & x
    return score


def edit_distance(a: list, b: list) -> int:
    """Edits between two lists; what they begin and end with alike is left out first."""
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    return _distance(a, b) if a and b else len(a) + len(b)
