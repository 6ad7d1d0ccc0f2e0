"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._text import small_batches
from textloom.llm.bpe import PLAIN_BELOW, plain_pattern

#: Fixed value: the splitting pattern of byte-level BPE files with "use_regex".
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Frequent pre-tokens whose counts every task gets at once, and their characters, at most. Bounds on the broadcast (some 10 MB), not on the result.
HEAD, HEAD_CHARS = 1 << 18, 64
#: A task proposes a pre-token for the head when it has met it so often.
HEAD_LEAST = 6
_NOT_PLAIN = re.compile(f"[^\\x00-{chr(PLAIN_BELOW - 1)}]")


class Splitter:
    """Pre-tokens of a text as a byte-level tokenizers file splits it; special tokens come apart first."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pattern = plain_pattern(BYTE_LEVEL)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens in order. Each one, taken alone, is a single pre-token again, so its count doesn't depend on its place."""
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(part)
            elif not _NOT_PLAIN.search(part):
                out += self.pattern.findall(part)
            else:
                out += [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def counts(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]


_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _propose(path: str) -> Step:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, seen = splitter(path), Counter()
        for part in parts:
            for text in part.column(0).to_pylist():
                seen.update(s.pieces(text or ""))
            if len(seen) > 2 * HEAD:  # what is rare so far is forgotten; that may only cost speed
                seen = Counter({p: n for p, n in seen.items() if n > 2})
        often = [(p, n) for p, n in seen.items() if n >= HEAD_LEAST and len(p) <= HEAD_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["piece", "n"])

    return run


def _frequencies(path: str, head) -> Step:
    """Per document a row with the tokens of its head pieces, and a row for each of its other pieces."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, get = splitter(path), head.value.get
        for part in parts:
            rids, rest = part.column(0).to_pylist(), ([], [], [])
            tokens, sizes = [], []
            for rid, text in zip(rids, part.column(2).to_pylist()):
                total, rare = 0, []
                for p in s.pieces(text or ""):
                    n = get(p)
                    if n is None:
                        rare.append(p)
                    else:
                        total += n
                tokens.append(total)
                sizes.append(len((text or "").encode()))
                if rare:
                    own = Counter(rare)
                    rest[0].extend([rid] * len(own))
                    rest[1].extend(own.keys())
                    rest[2].extend(own.values())
            n, m = len(rids), len(rest[0])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.nulls(n, pa.string()), pa.array(tokens, pa.int64())], names=NAMES)
            for a in range(0, m, 100_000):
                r, q, f = (x[a : a + 100_000] for x in rest)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.int64()), pa.array(q, pa.string()), pa.array(f, pa.int64())], names=NAMES)

    return run


#: tokens is a number of tokens where piece is null, and how often the document has the piece elsewhere.
NAMES = ["rid", "doc_id", "n_bytes", "piece", "tokens"]
SCHEMA = "rid long, doc_id long, n_bytes long, piece string, tokens long"


def _count_each(path: str) -> Step:
    """Rows sorted by piece, all of a piece in one partition: its tokens are counted at its first row, and what is kept is a batch's pieces."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, known = splitter(path), {}
        for part in parts:
            pieces = part.column(3).to_pylist()
            known[None] = 1
            here = set(pieces)
            new = [p for p in here if p not in known]
            known = {p: known[p] for p in here if p in known} | dict(zip(new, s.counts(new)))
            each = pa.array([known[p] for p in pieces], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.compute.multiply(each, part.column(4))], names=["rid", "doc_id", "n_bytes", "tokens"])

    return run


def head_counts(docs: DataFrame, path: str, text_col: str = "text", head: int = HEAD) -> dict[str, int]:
    """Token counts of the corpus's most frequent pre-tokens, at most `head` of them, none longer than HEAD_CHARS characters."""
    often = docs.select(F.col(text_col).alias("text")).mapInArrow(_propose(path), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [r.piece for r in often.orderBy(F.desc("n"), "piece").limit(head).collect()]
    return dict(zip(pieces, splitter(path).counts(pieces)))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Per document: n_bytes of its text (UTF-8), n_tokens, and over_limit (n_tokens > limit).

    A first pass finds the frequent pre-tokens; their counts, of bounded size, go to every task and join there.
    The others are dealt out by pre-token, each counted once where it lands, and summed per document; no ids are kept.
    A null text is empty and has no tokens. A row of the input is a row of the result, also where ids repeat or are
    null; an empty table gives an empty result.
    """
    small_batches(docs)
    known = docs.sparkSession.sparkContext.broadcast(head_counts(docs, path, text_col, head))
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = slim.mapInArrow(_frequencies(path, known), SCHEMA).repartition(F.xxhash64("piece", F.when(F.col("piece").isNull(), F.col("rid")))).sortWithinPartitions("piece")
    counted = dealt.mapInArrow(_count_each(path), "rid long, doc_id long, n_bytes long, tokens long")
    sums = counted.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
