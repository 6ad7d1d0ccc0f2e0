"""Near-duplicates by the exact Jaccard similarity of word shingles: SimHash links, and what they miss.

At a Jaccard similarity of 0.8 fingerprints differ in 9 to 14 of their 64 bits. A covering code for so many would need
blocks of some 8 bits, whose anchors hold a sixteenth of all documents each, so the operator's anchors find the close
copies here, and shingles that are rare find the rest; both are confirmed on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._components import components
from textloom.llm._text import Words, _mixed, batches, rolling, row_key, small_batches
from textloom.llm.simhash import fingerprint_batch, first_of_each, near_links
from textloom.session import materialise, scratch, temporary

#: Texts counted for the order of shingles, and how many shingles it may put last.
SAMPLE, LAST = 20_000, 100_000
#: Least number of cells of a sketch, and shingles for each cell of a larger one, see _sketch().
CELLS, LOAD = 128, 4
#: Sets of one shingle that are lined up together to find links between neighbours.
LINED_UP = 2000
#: Sets of one shingle up to which all of them that places allow are compared.
FEW = 40
#: Keys of texts that are sent to all tasks at most, of some 100 bytes each there. Where more are in doubt, texts are dealt out.
SENT = 1_000_000
#: Sets a task remembers, so as to pass on the rarest shingles of copies once.
REMEMBERED = 100_000


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; case of ASCII letters apart.

    A text of fewer words is one shingle, and one without words has the shingle zero.
    """
    for a, b in batches(texts, 1 << 20):
        w = Words(pc.ascii_lower(texts.slice(a, b - a)))
        one = w.hashes()
        runs = rolling(one, shingle)
        for first, last in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            n = last - first
            if n >= shingle:
                yield np.unique(runs[first : last - shingle + 1])
            else:
                yield rolling(one[first:last], n) + np.uint64(n) if n else np.zeros(1, np.uint64)


def _node(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a set, as two signed longs."""
    salts = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
    a, b = _mixed(np.array([np.sum(_mixed(hashes ^ np.uint64(x)), dtype=np.uint64) + np.uint64(len(hashes)) for x in salts])).view(np.int64).tolist()
    return a, b


def _sketch(hashes: np.ndarray) -> bytes | None:
    """How many shingles a set has in each part of the hash; None where a number doesn't fit into a byte.

    The parts are a power of two, so many that random sets of this size share too few for being similar.
    """
    cells = max(CELLS, 1 << (len(hashes) // LOAD).bit_length())
    counts = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _rarest(hashes: np.ndarray, last: np.ndarray, rank: np.ndarray, above: int) -> np.ndarray:
    """As many first shingles of a set, in an order common to all sets, as any set of `above` per cent Jaccard similarity meets.

    Of n shingles such a set has at least above per cent, so the rest and one more can't miss it. `last` (sorted) are
    shingles that come after all others, by rank.
    """
    n = len(hashes)
    most = n - -(-above * n // 100) + 1
    if len(last):
        at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
        often = last[at] == hashes
        hashes = np.concatenate([hashes[~often], hashes[often][np.argsort(rank[at[often]])]])
    return hashes[:most]


def _sets(shingle: int, last: np.ndarray, rank: np.ndarray, above: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part in parts:
            nodes, sizes, firsts, sketches, new = [], [], [], [], []
            for i, hashes in enumerate(shingle_sets(part.column(1), shingle)):
                node = _node(hashes)
                nodes.append(node)
                sizes.append(len(hashes))
                firsts.append(None if node in seen else _rarest(hashes, last, rank, above).view(np.int64))
                sketches.append(None if node in seen else _sketch(hashes))
                if node not in seen:
                    new.append(i)
                if len(seen) < REMEMBERED:
                    seen.add(node)
            fps = np.zeros(len(part), np.int64)
            for a in range(0, len(new), 500):
                at = new[a : a + 500]
                fps[at] = fingerprint_batch(part.column(1).take(pa.array(at, pa.int64())).to_pylist(), shingle).view(np.int64)
            fp = pa.array(fps, mask=np.array([x is None for x in firsts], bool))
            halves = [pa.array([x[k] for x in nodes], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *halves, pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), fp, pa.array(sketches, pa.binary())], names=["doc_id", "node", "check", "n", "first", "fp", "sketch"])

    return run


def _whole_sets(shingle: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in batches(part.column(1), 1 << 20):
                found = [x.view(np.int64) for x in shingle_sets(part.column(1).slice(a, b - a), shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])

    return run


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts has most often (sorted), and their ranks from rare to frequent.

    They only set the order of shingles: what is found doesn't depend on them, the number of comparisons does.
    """
    step = max(1, docs.count() // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select(F.xxhash64("key").alias("node"), "text")
    counted = some.mapInArrow(_whole_sets(shingle), "node long, hashes array<long>").select(F.explode("hashes").alias("h")).groupBy("h").count()
    rows = np.array([r.h for r in counted.filter("count > 3").orderBy(F.desc("count"), "h").limit(LAST).collect()], np.int64).view(np.uint64)
    order = np.argsort(rows)
    return rows[order], (len(rows) - np.arange(len(rows)))[order]


def _keep_shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, node, ...), sorted by these, without repeats, and without shingles that one set alone has."""
    before: pa.RecordBatch | None = None
    alone = True  # whether the row held back is so far the only one of its shingle
    for part in parts:
        if not len(part):
            continue
        now = part if before is None else pa.Table.from_batches([before, part]).combine_chunks().to_batches()[0]
        h, node = (now.column(k).to_numpy() for k in (0, 1))
        same = h[1:] == h[:-1]
        new = np.concatenate([[True], ~same | (node[1:] != node[:-1])])
        index = np.flatnonzero(new)
        h, same = h[index], h[index][1:] == h[index][:-1]
        paired = np.concatenate([[not alone], same]) | np.concatenate([same, [False]])
        before, alone = now.slice(int(index[-1]), 1), not paired[-1]
        yield now.take(pa.array(index[:-1][paired[:-1]]))
    if before is not None and not alone:
        yield before


def _possible(above: int) -> Column:
    """Whether sets x and y whose first common shingle is at their places i can be similar enough: by what is left behind it."""
    most = 1 + F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) - 1
    return (100 + above) * most >= above * (F.col("x.n") + F.col("y.n"))


def _pairs(joined: DataFrame, above: int) -> DataFrame:
    """(x, y) to distinct pairs (a, b) of nodes that can be similar enough."""
    ordered = [f(F.col("x.node"), F.col("y.node")).alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
    return joined.filter(F.col("x.node") != F.col("y.node")).filter(_possible(above)).select(*ordered).distinct()


def _largest(above: int) -> Column:
    """The greatest size of a set that a set of n shingles can be similar enough to where they first meet at its place i."""
    return F.floor((100 + above) * (F.col("n") - F.col("i")) / above).cast("int") - F.col("n")


def _class(size: Column) -> Column:
    """Sizes in classes, each some 4 % wide; small sizes are their own."""
    return F.when(size < 24, size).otherwise(F.floor(F.log(size.cast("double")) * 25) - 55).cast("int")


def _crossing(placed: DataFrame, above: int) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that meet at a shingle and can be similar enough; placed (h, node, n, i, root).

    The larger set asks for the sizes that it can be similar to at its place, and the smaller one answers where its own place
    lets it have a partner as large as itself, so at a shingle that very many texts have, pairs that sizes and places rule
    out are never made. Nor are pairs within the root that most sets of a shingle have: the others meet all, and these
    meet the others.
    """
    roots = placed.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count("*").alias("roots"), F.sum("c").alias("sets"))
    apart = materialise(placed.join(roots.filter("roots > 1").select("h", "major", (F.col("sets") > FEW).alias("many")), "h").withColumn("minor", F.col("root") != F.col("major")), "apart")
    me = F.struct("node", "n", "i", "root", "minor")
    fits = _largest(above)
    asks = apart.filter(fits >= F.ceil(F.col("n") * above / 100)).withColumn("most", F.least(F.col("n"), fits))
    # A shingle of few sets takes no classes: its pairs are fewer than the rows that asking for classes would make.
    classes = F.when(F.col("many"), F.sequence(_class(F.ceil(F.col("n") * above / 100)), _class(F.col("most")))).otherwise(F.array(F.lit(-1)))
    asks = asks.select("h", F.explode(classes).alias("size"), me.alias("x"), "most", "minor")
    answers = apart.filter(fits >= F.col("n")).select("h", F.when(F.col("many"), _class(F.col("n"))).otherwise(-1).alias("size"), me.alias("y"), fits.alias("fits"), "minor")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        rows = x.drop("minor").join(y.drop("minor"), ["h", "size"])
        return rows.filter((F.col("y.n") <= F.col("most")) & (F.col("x.n") <= F.col("fits")) & (F.col("x.root") != F.col("y.root"))).select("x", "y")

    return _pairs(met(asks.filter("minor"), answers).union(met(asks.filter("NOT minor"), answers.filter("minor"))), above)


def _by_fingerprint(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of nodes: a node with the first of its fingerprint, and the first nodes of linked fingerprints."""
    nodes = prints.filter("fp IS NOT NULL").select("fp", "node").distinct()
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("x")), "fingerprints")
    same = nodes.join(first, "fp").select(F.col("x").alias("a"), F.col("node").alias("b"))
    x, y = (first.select(F.col("fp").alias(c), F.col("x").alias(f"of_{c}")) for c in "ab")
    linked = near_links(first.select("fp"), distance).distinct().join(x, "a").join(y, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return same.union(linked).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_groups(docs: DataFrame, prints: DataFrame, shingle: int, above: int, distance: int = 3) -> DataFrame:
    """(node, root) of the nodes that pairs of sets of `above` per cent Jaccard similarity or more connect.

    docs (key, text); prints (doc_id: key, node, n, first, fp, sketch). Fingerprints within `distance` bits give pairs through
    their anchors. Every similar pair also meets at a shingle of both prefixes. First the sets of a shingle are compared
    with the most central of them, and neighbours in that order, so that a cluster of near copies costs a few
    comparisons for each member; then all pairs that these links don't connect and that sizes and places allow.
    """
    rows = prints.filter("first IS NOT NULL").select("node", "n", F.posexplode("first").alias("i", "h")).select("h", "node", "n", "i")
    shared = materialise(rows.repartition("h").sortWithinPartitions("h", "node").mapInArrow(_keep_shared, "h long, node long, n int, i int"), "shared")
    # An original shares all of its rarest shingles with its copies, and a copy lacks those that were edited.
    part = (F.col("meets") / (F.floor((100 - above) * F.col("n") / 100) + 1)).alias("part")
    central = shared.join(shared.groupBy("node").agg(F.count("*").alias("meets")), "node").select("h", "node", "n", "i", part)
    # Sets of a shingle that very many have are lined up in parts, and the first of each part meets the first of all.
    common = shared.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > LINED_UP)
    central = central.join(common, "h", "left").withColumn("line", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / LINED_UP)), F.lit(0)))
    me = F.struct("node", "n", "i")
    order = Window.partitionBy("h", "line").orderBy(F.desc("part"), "i", "node")
    near = central.select("h", "c", "part", me.alias("y"), F.lag(me).over(order).alias("before"), F.first(me).over(order).alias("head"))
    lined = near.select("y", F.explode(F.array("before", "head")).alias("x")).filter("x IS NOT NULL")
    firsts = near.filter("c IS NOT NULL AND before IS NULL").select("h", "part", "y")
    first = firsts.groupBy("h").agg(F.min(F.struct(-F.col("part"), "y")).alias("first")).select("h", F.col("first.y").alias("x"))
    central_pairs = _pairs(lined.union(firsts.join(first, "h").select("y", "x")), above)
    pairs = materialise(_not_excluded(_by_fingerprint(prints, distance).union(central_pairs).distinct(), prints, above), "pairs")
    links = _confirmed(docs, prints, pairs, shingle, above)
    roots = materialise(components(links), "roots")
    placed = shared.join(roots.withColumnRenamed("node", "other"), F.col("node") == F.col("other"), "left").select("h", "node", "n", "i", F.coalesce("root", "node").alias("root"))
    crossing = _crossing(placed, above)
    rest = materialise(_not_excluded(crossing.join(pairs, ["a", "b"], "left_anti"), prints, above), "pairs")
    return _merged(roots, _confirmed(docs, prints, rest, shingle, above))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links (a, b) between nodes, of which only their roots are contracted again."""
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    further = components(between)
    moved = roots.join(further.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return moved.union(further.join(roots, "node", "left_anti").select("node", "root"))


def _not_excluded(pairs: DataFrame, prints: DataFrame, above: int) -> DataFrame:
    """pairs without those that can't be similar enough: two sets share no more in each cell than the one with fewer has there."""

    def folded(sketches: pa.Array, cells: int, to: int) -> np.ndarray:
        return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, cells // to, to).sum(1, dtype=np.uint32)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            known = pc.and_(pc.is_valid(part.column(2)), pc.is_valid(part.column(3)))
            open_, part = part.filter(pc.invert(known)), part.filter(known)
            cells = np.stack([pc.binary_length(part.column(k)).to_numpy() for k in (2, 3)], 1)
            can = np.zeros(len(part), bool)
            for both in np.unique(cells, axis=0):
                at = np.flatnonzero((cells == both).all(1))
                x, y = (folded(part.column(k).take(pa.array(at)), int(c), int(both.min())) for k, c in zip((2, 3), both))
                can[at] = (100 + above) * np.minimum(x, y).sum(1, dtype=np.int64) >= above * (x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64))
            for left in (open_, part.filter(pa.array(can, pa.bool_()))):
                yield pa.RecordBatch.from_arrays(left.columns[:2], names=["a", "b"])

    sketches = prints.filter("sketch IS NOT NULL").groupBy("node").agg(F.min("sketch").alias("sketch"))
    x, y = (sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"of_{c}")) for c in "ab")
    joined = pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(run, "a long, b long")


def _apart(prints: DataFrame) -> DataFrame:
    """prints in which sets that only share half of their hash have nodes of their own: a few among 10**11, mostly none."""
    clash = prints.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).filter("least < most").select("node", "least")
    if clash.isEmpty():
        return prints
    other = F.when(F.col("check") > F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return materialise(prints.join(clash, "node", "left").withColumn("node", other).drop("least"), "sets")


def _confirmed(docs: DataFrame, prints: DataFrame, pairs: DataFrame, shingle: int, above: int) -> DataFrame:
    """Those pairs whose sets have `above` per cent Jaccard similarity or more, counted on all shingles."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Where few texts are in doubt, their keys are sent to the texts and not all texts around.
    keys = materialise(prints.join(needed, "node").groupBy("node").agg(F.min("doc_id").alias("key")), "keys")
    texts = docs.join(F.broadcast(keys) if keys.count() <= SENT else keys, "key")
    if not prints.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["key"])
    with scratch(texts.select("node", "text").mapInArrow(_whole_sets(shingle), "node long, hashes array<long>"), "sets") as sets:
        a, b = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
        both = F.size(F.array_intersect("of_a", "of_b"))
        return materialise(pairs.join(a, "a").join(b, "b").filter((100 + above) * both >= above * (F.size("of_a") + F.size("of_b"))).select("a", "b"), "similar")


def one_of_each(docs: DataFrame, shingle: int = 5, above: int = 80, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates: that with the smallest id, null as the last, then the smallest key.

    Documents link when the sets of their shingles have a Jaccard similarity of `above` per cent or more; groups are
    what links connect. All such pairs are found, none by chance. The key is 128 bits of hash of the id and text. Of rows
    that are equal in both, one stays. Null texts and those without words are one group. The columns are those of docs;
    an empty table stays empty. Of what is written on the way, only the keys of the rows that go are left at the end.
    """
    small_batches(docs)
    with temporary(docs.sparkSession):
        return _one_of_each(docs, shingle, above, distance, id_col, text_col)


def _one_of_each(docs: DataFrame, shingle: int, above: int, distance: int, id_col: str, text_col: str) -> DataFrame:
    key = row_key(id_col, text_col).alias("key")
    slim = docs.select(key, F.col(text_col).alias("text"))
    prints = materialise(slim.mapInArrow(_sets(shingle, *_frequent(slim, shingle), above), "doc_id binary, node long, check long, n int, first array<long>, fp long, sketch binary"), "sets")
    prints = _apart(prints)
    roots = similar_groups(slim, prints, shingle, above, distance)
    ids = docs.select(key, F.col(id_col).cast("long").alias("id")).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    rows = prints.select("doc_id", "node").join(ids, F.col("doc_id") == F.col("key")).select("doc_id", "node", "id", "n").distinct()
    grouped = rows.join(roots, "node", "left").select("doc_id", "id", "n", F.coalesce("root", "node").alias("component_id"))
    return first_of_each(docs, materialise(grouped, "groups"), key)
