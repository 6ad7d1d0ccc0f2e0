import hashlib
import re

import corpus_pipeline
import pytest
from test_mixing import levels, size
from test_quality import cleaned
from test_simhash import classes

from textloom.llm import bpe, quality, queries
from textloom.llm.queries import tokenizer_file
from textloom.session import materialise


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returns, written and read again."""
    docs, out = queries.table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return [queries.table(spark, sf_dir, "documents"), *out]


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "personal_data", "source_mixing", "token_ids"]


def test_columns_are_those_of_documents(stages):
    assert all(s.schema.names == stages[0].schema.names and [f.dataType for f in s.schema] == [f.dataType for f in stages[0].schema] for s in stages[1:-1])


def test_quality_stage(stages):
    """What is left, and of which text, by comparing every line with every document of its host."""
    want = cleaned([(r.doc_id, r.text, r.source) for r in stages[0].collect()], quality.Rules())
    assert sorted(((r.doc_id, r.text) for r in stages[1].collect()), key=repr) == want


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_near_duplicate_stage(stages):
    """Of each group that Jaccard similarities of 0.8 or more connect, over all pairs, the smallest id stays."""
    items = [(r.doc_id, shingles(r.text)) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(classes(items, alike)))


def test_personal_data_stage(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    assert any(re.search(mail, r.text) for r in before.values()) and not any(re.search(mail, r.text) for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mixing_stage(stages):
    """Each source has the words of its target, and documents are those of the stage before."""
    of = [{}, {}]
    for words, stage in zip(of, stages[3:5]):
        for r in stage.collect():
            words[r.source] = words.get(r.source, 0) + size(r.text)
    assert of[1] == {s: int(t) for s, t in levels(of[0]).items() if int(t)} and sum(of[1].values()) > 1.2 * sum(of[0].values())
    assert {r.doc_id for r in stages[4].collect()} <= {r.doc_id for r in stages[3].collect()}


def test_token_stage(stages):
    c = bpe.codec(tokenizer_file("word_bpe_49k.json"))
    texts = sorted((r.doc_id, hashlib.sha256(c.decode(c.encode(r.text)).encode()).hexdigest()) for r in stages[4].collect())
    assert texts == sorted((r.doc_id, r.decoded_sha256) for r in stages[5].collect())


def test_run_is_the_stages(spark, sf_dir, stages):
    rows = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(stages[5])


def test_empty_and_odd_tables(spark, make, corpus):
    for table in (make([]), make(corpus)):
        docs, seen = table, {}
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, ""), name)
            seen[name] = docs.count()
        assert (set(seen.values()) == {0}) == (table.count() == 0)
    # Nulls and rows without words go at the first stage; of repeated rows one is left after the second.
    texts = [(r[0], r[1]) for r in corpus]
    judged = cleaned([(r[0], r[1], r[2] if len(r) > 2 else "s1") for r in corpus], quality.Rules())
    assert seen["quality_rules"] == len(judged) < len(texts) and 0 < seen["near_dedup"] < len({t for _, t in judged}) + 1
    assert seen["personal_data"] == seen["near_dedup"] and seen["token_ids"] == seen["source_mixing"] >= seen["near_dedup"]


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
