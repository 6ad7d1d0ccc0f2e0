"""BPE encoding and decoding with a heap of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._text import small_batches

#: Characters below this are split by our own pattern, whose classes are spelt out; other texts by the library's splitter.
PLAIN_BELOW = 0x250
#: Entries a worker remembers of the words it has encoded; then it starts anew. Speed only.
MEMO = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that print in Latin-1 stand for themselves; the others take the characters from U+0100 on, in order.
    """
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    spare = iter(range(256, 512))
    own = {b: chr(b) for b in printable}
    return [own[b] if b in own else chr(next(spare)) for b in range(256)]


def plain_pattern(pattern: str) -> re.Pattern:
    r"""pattern with \p{L} and \p{N} spelt out for the characters below PLAIN_BELOW."""
    letters, numbers = ("".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if unicodedata.category(chr(c))[0] == k) for k in "LN")
    space = "\\t-\\r \\x85\\xa0"
    for a, b in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]"), (r"[\p{L}]", f"[{letters}]"), (r"[\p{N}]", f"[{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        pattern = pattern.replace(a, b)
    return re.compile(pattern)


_NOT_PLAIN = re.compile(f"[^\\x00-{chr(PLAIN_BELOW - 1)}]")


class BpeCodec:
    """A tokenizers file with a BPE model: text to ids and ids to text.

    The merges run here; normalising and the splitting of texts with rarer characters are the library's.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.added).items()}
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.alphabet = byte_alphabet()
        self.memo: dict[str, bytes] = {}
        self.mapped_memo: dict[str, bytes] = {}
        split = next((p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        self.pattern = plain_pattern(split) if split else None

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token, given in the byte alphabet.

        A heap holds (rank, position, left, right) for neighbouring symbols; an entry whose symbols have
        changed since is stale and skipped. next and prev link the symbols that are left.
        """
        symbols = [self.vocab[c] for c in piece[:-1]] + [self.vocab[piece[-1] + self.suffix]]
        n = len(symbols)
        if n == 1:
            return symbols
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        following[-1] = -1
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            found = ranks.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = following[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            k = following[i] = following[j]
            if k >= 0:
                previous[k] = i
                found = ranks.get((made, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            h = previous[i]
            if h >= 0:
                found = ranks.get((symbols[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
        return [s for s in symbols if s >= 0]

    def _remember(self, piece: str, memo: dict[str, bytes], mapped: str | None = None) -> bytes:
        if mapped is None:
            mapped = "".join([self.alphabet[b] for b in piece.encode()])
        ids = self.merge(mapped)
        if len(memo) >= MEMO:
            memo.clear()
        out = memo[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(struct.pack("<I", self.added[part]))
            elif part:
                part = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                if self.pattern and not _NOT_PLAIN.search(part):
                    out += [memo.get(p) or self._remember(p, memo) for p in self.pattern.findall(part)]
                else:
                    # The library's splitter already gives the byte alphabet, so it has a memory of its own.
                    out += [self.mapped_memo.get(m) or self._remember(m, self.mapped_memo, m) for m, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return unpacked(self.packed(text))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, joined as the library joins them where its file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


_codecs: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The file's codec; each worker process builds it once."""
    if path not in _codecs:
        _codecs[path] = BpeCodec(path)
    return _codecs[path]


def _encode(path: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in parts:
            packed = [c.packed(text or "") for text in part.column(1).to_pylist()]
            counts = [len(p) // 4 for p in packed]
            texts = [hashlib.sha256(c.decode(unpacked(p)).encode()).hexdigest() for p in packed]
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array(texts, pa.string())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return run


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of the packed ids and of the text decoded from them, and the ids as an array if asked for.

    A null text is empty: no tokens. Rows are independent, so repeated ids and texts give repeated rows, and an
    empty table an empty result. Nothing is shuffled. A very long text takes memory of some 30 times its bytes in its task.
    """
    small_batches(docs)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_encode(path, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of doc_id and ids: the text, vocabulary strings concatenated (null ids: empty)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in parts:
            texts = [c.decode(x or []) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
