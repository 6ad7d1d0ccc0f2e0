"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._text import small_batches
from textloom.session import materialise

#: Words in a leaf, and paragraphs in a section that no blank line ends before.
LEAF_WORDS = 8
SECTION_PARAGRAPHS = 8


def _digest(kind: bytes, *parts: bytes) -> bytes:
    """Leaves and inner nodes are hashed with different kinds, so that none passes for the other."""
    return hashlib.blake2b(b"".join(parts), digest_size=16, person=kind).digest()


@dataclass(slots=True)
class Node:
    """digest commits to all below; weight is the number of characters below."""

    digest: bytes
    weight: int
    children: list[Node] = field(default_factory=list)


def _node(kind: bytes, children: list[Node]) -> Node:
    return Node(_digest(kind, *[c.digest for c in children]), sum([c.weight for c in children]), children)


def tree(text: str) -> Node:
    """The root over sections (ended by a blank line or SECTION_PARAGRAPHS paragraphs), paragraphs (lines) and leaves.

    A leaf is LEAF_WORDS words of a line with the white space between them, so the leaves of a text hold every
    character of it, and roots are equal just when texts are.
    """
    sections, current = [], []
    for line in text.split("\n"):
        words = line.split(" ")
        leaves = [" ".join(words[i : i + LEAF_WORDS]) for i in range(0, len(words), LEAF_WORDS)]
        current.append(_node(b"paragraph", [Node(_digest(b"leaf", x.encode()), len(x) + 1) for x in leaves]))
        if len(current) == SECTION_PARAGRAPHS or not line:
            sections.append(_node(b"section", current))
            current = []
    if current:
        sections.append(_node(b"section", current))
    return _node(b"root", sections)


def differing(a: Node, b: Node) -> tuple[list[Node], list[Node]]:
    """The leaves below branches that differ; equal branches aren't entered."""
    if a.digest == b.digest:
        return [], []
    if not a.children or not b.children:
        return _leaves(a), _leaves(b)
    left, right = [], []
    for i in range(max(len(a.children), len(b.children))):
        x, y = a.children[i : i + 1], b.children[i : i + 1]
        more = differing(x[0], y[0]) if x and y else (_leaves(x[0]) if x else [], _leaves(y[0]) if y else [])
        left += more[0]
        right += more[1]
    return left, right


def _leaves(node: Node) -> list[Node]:
    return [leaf for c in node.children for leaf in _leaves(c)] if node.children else [node]


def likeness(a: Node, b: Node) -> float:
    """Twice the characters that two trees share over the characters of both: 1 for equal texts.

    Branches with equal digests count whole. Leaves below differing branches also count where the other side has
    them elsewhere, so a paragraph that moved is not lost.
    """
    if a.digest == b.digest:
        return 1.0
    left, right = differing(a, b)
    shared = a.weight - sum([x.weight for x in left])
    there = Counter([x.digest for x in right])
    for x in left:
        if there[x.digest] > 0:
            there[x.digest] -= 1
            shared += x.weight
    return min(1.0, 2.0 * shared / (a.weight + b.weight))


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, own: Node, following: str, next_tree: Node) -> tuple:
    changed = edited(text, following)
    changed_tree = tree(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.digest.hex(), changed_tree.digest.hex(), likeness(own, changed_tree), likeness(own, next_tree)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])


_EDGES = f"{_OUT}, at int, row_text string, is_last boolean"


def _in_order(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a sorted partition but the last, each with the next; then its first and last row with their texts."""
    at = TaskContext.get().partitionId()
    first, last = None, None

    def out(rows: list[tuple], ends: list[tuple] = ()) -> pa.RecordBatch:
        found = _batch([*rows, *((d, *[None] * 6) for d, _, _ in ends)])
        edge = lambda values, kind: pa.array([None] * len(rows) + values, kind)
        more = [edge([at] * len(ends), pa.int32()), edge([t for _, t, _ in ends], pa.string()), edge([x for _, _, x in ends], pa.bool_())]
        return pa.RecordBatch.from_arrays([*found.columns, *more], names=[x.split()[0] for x in _EDGES.split(", ")])

    for part in parts:
        rows = []
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            now = tree(text)
            if last:
                rows.append(_row(*last, text, now))
            else:
                first = (doc_id, text, False)
            last = (doc_id, text, now)
        yield out(rows)
    if last:
        yield out([], [first, (*last[:2], True)])


def _in_pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        yield _batch([_row(d, t, tree(t), x, tree(x)) for d, t, x in zip(*(c.to_pylist() for c in part.columns))])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars and fingerprint, the root of its tree (null text: empty)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([tree(t).digest.hex() for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to the edited and the next text.

    The next document is the next in ascending (doc_id, text), nulls first; after the last comes the first. A null
    text is empty. Every row gives one row, also where ids repeat; a single document is its own next, and an empty
    table gives an empty result. Columns besides these two are not looked at.

    The texts are range-partitioned and sorted once; each partition works on neighbours in a stream and writes its
    results, with its first and last text. Only these, two a partition, are joined: the window that says which partition
    comes next is over numbers of partitions.
    """
    small_batches(docs)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id, such as null, may go to several partitions by the beginning of their texts.
    ranged = slim.repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    written = materialise(ranged.mapInArrow(_in_order, _EDGES), "merkle")
    edges = written.filter("at IS NOT NULL")
    order = Window.orderBy("at")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = edges.filter("is_last").select("at", F.coalesce(F.lead("at").over(order), F.first("at").over(every)).alias("next"))
    first = edges.filter("NOT is_last").select(F.col("at").alias("next"), F.col("row_text").alias("following"))
    lasts = edges.filter("is_last").join(following, "at").join(first, "next").select("doc_id", F.col("row_text").alias("text"), "following")
    return written.filter("at IS NULL").drop("at", "row_text", "is_last").unionByName(lasts.mapInArrow(_in_pairs, _OUT))
