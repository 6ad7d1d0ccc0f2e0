"""Near-duplicates by a set similarity join on chosen paths: trees of minwise tokens whose small nodes are compared in full.

A set goes down each tree. At a node it takes one or two of its minwise values, which the node chooses, and comes to a child for
each; on average 1 / similarity, so two similar sets are expected to share a child at every length of the path. Nodes
that hold few sets are compared exhaustively, larger ones branch again. Trees are independent, and so many that hardly
a similar pair is in none of the leaves; what they bring together is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._text import _mixed, batches, row_key, small_batches
from textloom.llm.jaccard import _apart, _merged, _node, _whole_sets, shingle_sets
from textloom.session import materialise, scratch, temporary

#: Minwise values of a set, of which nodes choose; and those of one bit each that rule out pairs.
VALUES = 128
#: Parts of the hash of shingles, a bit each, by which pairs of small sets are ruled out for certain.
CELLS = 1024
#: Trees, the length of a path at which nodes are first looked at, and the greatest length.
TREES, FIRST, LAST = 20, 2, 5
#: A node is compared in full when so many of its sets at most aren't in the component that most are in; and sets of a block of a large node.
SMALL, BLOCK = 4096, 4096
#: Links tried for a set before pairs are made.
STARS = 6
#: Keys of texts that are sent to all tasks at most, of some 100 bytes each there. Where more are in doubt, texts are dealt out.
SENT = 1_000_000
#: Sets a task remembers, so that copies are signed once, and shingles that are hashed at once.
REMEMBERED, AT_ONCE = 100_000, 2048
#: Standard deviations that the bits of a similar pair may differ by more than expected: about one pair in 10**8 is lost by that.
DEVIATIONS = 6.2

_SALT = _mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR, _ADDED = _SALT[:VALUES] | np.uint64(1), _SALT[VALUES:]


def minwise(hashes: np.ndarray) -> np.ndarray:
    """VALUES minwise values, of 32 bits, of a set of 64-bit hashes that isn't empty."""
    least = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(hashes), AT_ONCE):
        block = np.multiply.outer(_FACTOR, hashes[a : a + AT_ONCE])
        block += _ADDED[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of two 64-bit words for each row of minwise values: a bit of hash of each value."""
    bit = (_mixed(values.astype(np.uint64) + _SALT[:VALUES]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bit, axis=1, bitorder="little").view("<u8").view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """CELLS bits as signed longs: whether a set has an odd number of shingles in each part of the hash.

    Where two sets differ in a bit, a shingle is in only one of them.
    """
    odd = np.bincount((hashes & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8").view(np.int64)


def _sets(shingle: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part in parts:
            nodes, sizes, values, odd = [], [], [], []
            for hashes in shingle_sets(part.column(2), shingle):
                empty = len(hashes) == 1 and not hashes[0]
                node = _node(hashes)
                nodes.append(node)
                sizes.append(0 if empty else len(hashes))
                new = not empty and node not in seen
                values.append(minwise(hashes).tobytes() if new else None)
                odd.append(parity(hashes) if new else None)
                if len(seen) < REMEMBERED:
                    seen.add(node)
            halves = [pa.array([x[k] for x in nodes], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *halves, pa.array(sizes, pa.int32()), pa.array(values, pa.binary()), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "id", "node", "check", "n", "values", "odd"])

    return run


def _children(paths: np.ndarray, rows: np.ndarray, values: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """(paths, rows) one token longer: each path chooses one of the values of its row, or two, 1 + branch of them on average."""
    chosen = _mixed(paths ^ np.uint64(0xA0761D6478BD642F))
    first = (chosen % np.uint64(VALUES)).astype(np.int64)
    second = (first + 1 + ((chosen >> np.uint64(8)) % np.uint64(VALUES - 1)).astype(np.int64)) % VALUES
    two = (chosen >> np.uint64(32)).astype(np.float64) < branch * 2.0**32
    which = np.concatenate([first, second[two]])
    parents, of = np.concatenate([paths, paths[two]]), np.concatenate([rows, rows[two]])
    token = values[of, which].astype(np.uint64) | which.astype(np.uint64) << np.uint64(32)
    return _mixed(parents * np.uint64(0xE7037ED1A0B428DB) + _mixed(token)), of


def _grow(branch: float, levels: int, trees: int | None):
    """(node, n, values, paths) to (path, node, n, s, t): paths grown by some levels, from the roots of trees where that number is given."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, len(part), 500):
                some = part.slice(a, 500)
                values = np.frombuffer(b"".join(some.column(2).to_pylist()), np.uint32).reshape(-1, VALUES)
                if trees:
                    paths = np.tile(_mixed(np.arange(1, trees + 1, dtype=np.uint64)), len(some))
                    rows = np.repeat(np.arange(len(some)), trees)
                else:
                    lists = some.column(3)
                    paths, rows = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy())
                for _ in range(levels):
                    paths, rows = _children(paths, rows, values, branch)
                bits, take = _bits(values), pa.array(rows)
                columns = [pa.array(paths.view(np.int64)), some.column(0).take(take), some.column(1).take(take), *(pa.array(np.ascontiguousarray(bits[rows, k])) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "node", "n", "s", "t"])

    return run


GROWN = "path long, node long, n int, s long, t long"


def _can(above: int) -> Column:
    """Whether sets x and y can be similar enough, by their sizes and the bits in which they differ."""
    differ = (1 - above / 100) / 2
    most = VALUES * differ + DEVIATIONS * math.sqrt(VALUES * differ * (1 - differ))
    small, large = (f(F.col("x.n"), F.col("y.n")) for f in (F.least, F.greatest))
    bits = F.bit_count(F.col("x.s").bitwiseXOR(F.col("y.s"))) + F.bit_count(F.col("x.t").bitwiseXOR(F.col("y.t")))
    return (100 * small >= above * large) & (bits <= int(most))


def _ordered() -> list[Column]:
    return [f(F.col("x.node"), F.col("y.node")).alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]


def _stars(members: DataFrame, sets: DataFrame, above: int) -> DataFrame:
    """Pairs (a, b): each set and the closest, by parities, of the sets that its nodes have picked, of another component: STARS of them at most.

    A node picks one by hash, so that the nodes of a set, which share most of their sets, pick different ones. The bits of
    minwise values only say which may be similar at all: in a group of near copies they would choose among the picked by chance.
    """
    me = F.struct("node", "n", "s", "t", "root")
    heads = members.groupBy("path").agg(F.min(F.struct(F.xxhash64("node", "path").alias("k"), me.alias("y"))).alias("first")).select("path", "first.y")
    met = members.select("path", me.alias("x")).join(heads, "path").filter("x.root <> y.root").filter(_can(above))
    # A set has a node or two in each tree, so few heads.
    met = met.select(F.col("x.node").alias("node"), F.col("x.n").alias("n"), F.col("y.node").alias("head"), F.col("y.n").alias("head_n")).distinct()
    odd = lambda c, name: sets.select(F.col("node").alias(c), F.col("odd").alias(name))
    both = met.join(odd("head", "y_odd"), "head").join(odd("node", "x_odd"), "node")
    both = both.select("node", "head", F.struct("n", F.col("x_odd").alias("odd")).alias("x"), F.struct(F.col("head_n").alias("n"), F.col("y_odd").alias("odd")).alias("y")).filter(_few_differ(above))
    share = _differing() / (F.col("x.n") + F.col("y.n"))
    near = both.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct(share.alias("share"), "head"))), 1, STARS).alias("near"))
    best = near.select("node", F.explode("near.head").alias("head"))
    return best.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _unconnected(placed: DataFrame) -> DataFrame:
    """The rows of nodes with several components, with major, the component that most of a node's sets are in, size, and minors, how many are in others."""
    counts = placed.groupBy("path", "root").agg(F.count("*").alias("c"))
    nodes = counts.groupBy("path").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.sum("c").alias("size"), (F.sum("c") - F.max("c")).alias("minors"), F.count("*").alias("roots"))
    return placed.join(nodes.filter("roots > 1").select("path", "major", "size", "minors"), "path")


def _differing() -> Column:
    """How many bits of parity() differ between sets x and y."""
    return sum((F.bit_count(F.col("x.odd")[i].bitwiseXOR(F.col("y.odd")[i])) for i in range(CELLS // 64)), F.lit(0))


def _few_differ(above: int) -> Column:
    """Whether sets x and y may be similar enough by the bits of parity(), each of which that differs is a shingle of one alone. Exact."""
    return (100 + above) * _differing() <= (100 - above) * (F.col("x.n") + F.col("y.n"))


def _exhaustive(apart: DataFrame, above: int) -> DataFrame:
    """Pairs (a, b) of different components within the nodes, all of them compared; rows of _unconnected(), with odd.

    Sets of the component that most are in don't meet each other: the others meet all. Those are dealt out to blocks of
    the node, so that a large one isn't a task's alone.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    me = F.struct("node", "n", "s", "t", "root", "odd")
    x = apart.filter(F.col("root") != F.col("major")).select("path", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), me.alias("x"))
    y = apart.select("path", F.pmod(F.xxhash64("node", "path"), blocks).cast("int").alias("block"), F.struct("node", "n", "s", "t", "root", "odd", "major").alias("y"))
    # Two sets that are both outside the largest component meet once.
    met = x.join(y, ["path", "block"]).filter("x.root <> y.root AND (y.root = y.major OR x.node < y.node)").filter(_can(above)).filter(_few_differ(above))
    return met.select(*_ordered()).distinct()


class _Confirm:
    """Confirms pairs of sets on their full sets; docs (key, text), sets (node, key, ...)."""

    def __init__(self, docs: DataFrame, sets: DataFrame, shingle: int, above: int, repeated: bool):
        self.docs, self.sets, self.shingle, self.above, self.repeated = docs, sets, shingle, above, repeated

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose sets have `above` per cent Jaccard similarity or more."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        keys = materialise(self.sets.select("node", "key").join(needed, "node").select("node", "key"), "keys")
        texts = self.docs.join(F.broadcast(keys) if keys.count() <= SENT else keys, "key").select("node", "text")
        if self.repeated:
            texts = texts.dropDuplicates(["node"])
        above = self.above
        with scratch(texts.mapInArrow(_whole_sets(self.shingle), "node long, hashes array<long>"), "sets") as full:
            a, b = (full.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
            both = F.size(F.array_intersect("of_a", "of_b"))
            enough = (100 + above) * both >= above * (F.size("of_a") + F.size("of_b"))
            return materialise(pairs.join(a, "a").join(b, "b").filter(enough).select("a", "b"), "similar")


def _joined(sets: DataFrame, confirm: _Confirm, above: int) -> DataFrame:
    """(node, root) of the sets (node, n, values, ...) that similar pairs connect with a root; roots themselves may be left out."""
    branch = 100 / above - 1
    signed = sets.select("node", "n", "values")
    grown = signed.mapInArrow(_grow(branch, FIRST, TREES), GROWN)
    roots, links = signed.limit(0).select("node", F.col("node").alias("root")), []
    for length in range(FIRST, LAST + 1):
        shared = grown.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1").select("path")
        members = materialise(grown.join(shared, "path"), "members")
        # Copies of one text are close to the first set of some node of theirs, and connected by that before pairs are made.
        links.append(confirm.links(materialise(_stars(_placed(members, roots), sets, above), "stars")))
        roots = _hung(roots, links[-1])
        placed = _placed(members, roots)
        apart = materialise(_unconnected(placed).join(sets.select("node", "odd"), "node"), "apart")
        leaves = apart if length == LAST else apart.filter(F.col("minors") <= SMALL)
        links.append(confirm.links(materialise(_exhaustive(leaves, above), "pairs")))
        large = apart.filter(F.col("minors") > SMALL)
        if length == LAST or large.isEmpty():
            break
        roots = _hung(roots, links[-1])
        onward = large.groupBy("node").agg(F.collect_list("path").alias("paths")).join(signed, "node").select("node", "n", "values", "paths")
        grown = materialise(onward.mapInArrow(_grow(branch, 1, None), GROWN), "grown")
    return materialise(_merged(roots, reduce(DataFrame.unionByName, links)), "roots")


def _hung(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after links (a, b): each root hangs below the smallest one that it is linked with, as far as two jumps reach, three times.

    Sets of one root are connected, but connected ones may still have several; that only costs comparisons. All links are
    contracted at the end.
    """
    return _hung_once(_hung_once(_hung_once(roots, links), links), links)


def _hung_once(roots: DataFrame, links: DataFrame) -> DataFrame:
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    up = materialise(between.filter("a <> b").groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "up")
    for _ in range(2):
        up = up.join(up.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    up = materialise(up, "up")
    moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return materialise(moved.union(up.join(roots, "node", "left_anti").select("node", "root")), "roots")


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with the root of each set."""
    known = roots.select(F.col("node").alias("other"), "root")
    return members.join(known, F.col("node") == F.col("other"), "left").withColumn("root", F.coalesce("root", "node")).drop("other")


def near_duplicates(docs: DataFrame, shingle: int = 2, above: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept. Documents link at a Jaccard similarity of `above` per cent or more.

    A document's set has its distinct shingles of words, with A-Z lower-cased; with fewer words the whole sequence is one
    shingle. A text without words, or null, has none and is linked with nothing. component_id is the smallest doc_id that
    links reach, itself included (null only where all ids are). kept: whether that is the doc_id (null with null, too).
    Equal sets are one from the start. A similar pair isn't met with a chance of about 10**-6 at a similarity of `above`,
    less at higher ones; what is met is confirmed on full sets, so no link is false. Repeated rows give repeated rows
    of one component, and an empty table gives an empty result. above is from 50 to 100.
    """
    if not 50 <= above <= 100:
        raise ValueError("above must be from 50 to 100")
    small_batches(docs)
    with temporary(docs.sparkSession):
        key = row_key(id_col, text_col).alias("key")
        slim = docs.select(F.col(id_col).cast("long").alias("id"), key, F.col(text_col).alias("text"))
        rows = slim.select("key", "id", "text").mapInArrow(_sets(shingle), "doc_id binary, id long, node long, check long, n int, values binary, odd array<long>")
        rows = _apart(materialise(rows, "signed"))
        # The first text of each set stands for it; the values of one copy are those of all.
        sets = rows.filter("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("key"), F.min("id").alias("least"), F.max("values").alias("values"), F.max("odd").alias("odd"))
        sets = materialise(sets, "distinct")
        repeated = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
        roots = _joined(sets, _Confirm(slim, sets, shingle, above, repeated), above)
        placed = materialise(_placed(sets.select("node", "least"), roots), "placed")
        smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k")).filter("k > 1").select("root", "component_id")
        component = placed.join(smallest, "root", "left").select(F.col("node").alias("of"), F.coalesce("component_id", "least").alias("component_id"))
        own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
        out = rows.join(component, F.col("node") == F.col("of"), "left").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
        return materialise(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "components", stays=True)
