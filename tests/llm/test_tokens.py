import hashlib
import random
import struct

import pytest

from textloom.llm import bpe, token_counts
from textloom.llm.queries import tokenizer_file

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts(n=300):
    rng = random.Random(3)
    parts = ["a", "B", "é", "ß", "Ł", "ı", "İ", "ﬁ", "你", "好", "😀", "👍🏽", " ", "  ", "\n", "\t", " ", " ", "​", "\x00", "\x85", "'s", "'LL", "’s", "12", "3", "½", "²", "!", "...", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "_", "-", "é", "́", "ǆ", "ʼ", "الع", "﻿", "don't", "Hello", "the"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(n)] + ["x" * 5000, "ab" * 4000, " " * 3000, "é" * 2000, ""]


@pytest.mark.parametrize("head", [0, 5, token_counts.HEAD])
def test_counts_are_the_librarys(make, corpus, rows_of, head):
    t = library(BYTE)
    rows = corpus + [(1000 + i, x) for i, x in enumerate(odd_texts())]
    found = rows_of(token_counts.count_tokens(make(rows), BYTE, head=head))
    n = [len(e.ids) for e in t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    assert found == sorted(((r[0], len((r[1] or "").encode()), k, k > 1024) for r, k in zip(rows, n)), key=repr)


def test_codec_is_the_librarys():
    t, c = library(WORD), bpe.codec(WORD)
    for x in odd_texts(1500):
        ids = t.encode(x, add_special_tokens=False).ids
        assert c.encode(x) == ids, x
        assert c.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_encoded_documents(make, corpus, rows_of):
    t = library(WORD)
    rows = corpus + [(1000 + i, x) for i, x in enumerate(odd_texts(50))]
    encoded = bpe.encode_documents(make(rows), WORD)
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    assert rows_of(encoded) == sorted(want, key=repr)
    texts = rows_of(bpe.decode_documents(encoded, WORD))
    assert texts == sorted(((r[0], t.decode(w[4], skip_special_tokens=False)) for r, w in zip(rows, want)), key=repr)


def test_decoding_of_no_ids(spark, rows_of):
    assert rows_of(bpe.decode_documents(spark.createDataFrame([(1, None), (None, [])], "doc_id long, ids array<int>"), WORD)) == [(1, ""), (None, "")]


def test_empty_table(make, rows_of):
    assert rows_of(token_counts.count_tokens(make([]), BYTE)) == [] and rows_of(bpe.encode_documents(make([]), WORD)) == []
