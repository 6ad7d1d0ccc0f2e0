"""Which sources of a language differ in their terms, and by which: exact integer divergences over blocks of terms.

A block is a dense matrix of int64, groups by terms. All pairs of groups are compared by broadcasting tiles of it;
partial sums of pairs are added up over blocks, and the best terms of each group in a block are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._text import Words, batches, small_batches
from textloom.session import materialise

#: Bytes that a term doesn't have: all of ASCII but letters. Characters beyond ASCII are bytes from 128 on in UTF-8.
NOT_A_TERM = np.array([not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])
#: Bytes of text that are counted at once, and cells of a matrix of groups by terms, and of a tile of pairs of groups by terms.
BLOCK, CELLS, TILE = 8 << 20, 1 << 19, 1 << 20
#: Probabilities are in parts of this number, which is a product of STEP * STEP * STEP.
UNIT, STEP = 10**9, 10**3


def _count_terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs): occurrences, and texts with the term, summed over some texts.

    A pair of lang and source that has no term is a row with a null term.
    """
    for part in parts:
        for a, b in batches(part.column(2), BLOCK):
            some = part.slice(a, b - a)
            groups, group = np.unique([f"{len(x)}:{x}{y}" for x, y in zip(some.column(0).to_pylist(), some.column(1).to_pylist())], return_index=True, return_inverse=True)[1:]
            words = Words(pc.ascii_lower(some.column(2)), NOT_A_TERM)
            _, example, term = np.unique(words.hashes(), return_index=True, return_inverse=True)
            document = words.document()
            each, n = np.unique(group[document] * np.int64(len(example)) + term, return_counts=True)
            pairs = np.unique(document * np.int64(len(example)) + term)
            held = group[pairs // max(1, len(example))] * np.int64(len(example)) + pairs % max(1, len(example))
            docs = np.bincount(np.searchsorted(each, held), minlength=len(each))
            which, of = each % max(1, len(example)), groups[each // max(1, len(example))]
            data = words.data.tobytes()
            spelled = pa.array([data[words.starts[k] : words.ends[k]].decode() for k in example.tolist()], pa.string()).take(pa.array(which))
            rows = [some.column(k).take(pa.array(of)) for k in (0, 1)] + [spelled, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(rows, names=NAMES)
            yield pa.RecordBatch.from_arrays([some.column(k).take(pa.array(groups)) for k in (0, 1)] + [pa.nulls(len(groups), pa.string()), *[pa.array(np.zeros(len(groups), np.int64))] * 2], names=NAMES)


NAMES = ["lang", "source", "term", "n", "docs"]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), one row for each; nulls are empty strings, and every lang and source has a row with a null term.

    Texts are counted where they are, so a source with a third of all texts is a few rows for each block of text.
    """
    small_batches(docs, rows=4000)
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = slim.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / total) for 0 < count + 2 <= total < 2**53, in integers, by long division."""
    rest, out = count + 2, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    for _ in range(3):
        rest = rest * STEP
        out = out * STEP + rest // total
        rest = rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(p: np.ndarray) -> np.ndarray:
    """The divergence of each pair of rows, summed over columns; a tile of rows against all rows at a time."""
    out = np.zeros((len(p), len(p)), np.int64)
    wide = max(1, TILE // max(1, len(p)))
    for c in range(0, p.shape[1], wide):
        block = p[:, c : c + wide]
        high = max(1, TILE // max(1, block.size))
        for a in range(0, len(p), high):
            out[a : a + high] += divergence(block[a : a + high, None, :], block[None, :, :]).sum(2)
    return out


def _block(best: int):
    def run(lang: tuple, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        """One block of a language: counts (term, source, n) of its terms, and all groups (source, total, terms)."""
        groups = groups.sort_values("source", ignore_index=True)
        sources, terms = groups["source"].to_numpy(), counts["term"].unique()
        n = np.zeros((len(sources), len(terms)), np.int64)
        n[pd.Index(sources).get_indexer(counts["source"]), pd.Index(terms).get_indexer(counts["term"])] = counts["n"]
        vocabulary = 2 * groups["terms"].to_numpy(np.int64)
        p = probability(n, (groups["total"].to_numpy(np.int64) + vocabulary)[:, None])
        sums = _pair_sums(p)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        out = [pd.DataFrame({"source": sources[a], "part": "pair", "item": sources[b], "value": sums[a, b]})]
        if len(terms):
            total = np.array([groups["total"].sum() + vocabulary[0]], np.int64)
            q = probability(n.sum(0), total)
            f = np.where((n > 0) & (p > q), divergence(p, q), -1)
            by_name = np.argsort(np.array([t.encode() for t in terms], dtype=object), kind="stable")
            for k in range(len(sources)):
                top = by_name[np.argsort(-f[k, by_name], kind="stable")[:best]]
                top = top[f[k, top] >= 0]
                out.append(pd.DataFrame({"source": sources[k], "part": "term", "item": terms[top], "value": f[k, top]}))
        found = pd.concat(out, ignore_index=True)
        found.insert(0, "lang", lang[0])
        return found

    return run


def source_divergence(docs: DataFrame, least_docs: int = 10, best: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Divergences (lang, source, part, item, value, rank) between the sources of each language, and of their terms from the language.

    Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased; a language keeps the V of them that
    are in at least least_docs of its texts. With N its occurrences of kept terms, a group (a source of a language, or the language) gives
    a kept term that it has count times p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)). Two values diverge by
    floor((p - q)**2 / (p + q)). Part `pair`: each other source of the language, summed over kept terms (0 if there are none).
    Part `term`: kept terms that the group has and gives more than the language does, the first `best` of them. Ranks are by
    value, descending, then by the item's UTF-8 bytes. All arithmetic is in integers; N + 2 * V has to be below 2**53.

    Null langs, sources and texts are empty strings, and a group without terms takes part. Repeated rows count each. A
    language of one source has no row in part `pair`. An empty table gives no row. The result has a row for each pair of
    sources of a language, so the sources of one are meant to be some thousands at most.
    """
    counts = materialise(term_counts(docs, text_col, lang_col, source_col), "terms")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term")
    used = materialise(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept")
    groups = counts.filter("term IS NULL").select("lang", "source").join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(used.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), "sources")
    # So many blocks that a matrix of all groups by the terms of one has about CELLS cells.
    sizes = materialise(sizes.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / CELLS)).cast("int")), "sizes")
    number: Column = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    blocked = used.join(sizes.select("lang", "blocks"), "lang").select("lang", number.alias("block"), "term", "source", "n")
    headed = groups.join(sizes, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.coalesce("total", F.lit(0)).alias("total"), "terms")
    parts = blocked.groupBy("lang", "block").cogroup(headed.groupBy("lang", "block")).applyInPandas(_block(best), "lang string, source string, part string, item string, value long")
    parts = materialise(parts, "parts")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.union(terms)
