import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, bucket int, rid long, __key string"


def _row(doc_id, text, source="s1"):
    """Documents with extra columns whose names the operators use inside."""
    return doc_id, text, "en", source, len(text or ""), -1, "x", 7, 3, "k"


@pytest.fixture
def make(spark):
    """make([(doc_id, text[, source])]) is a table of documents."""
    return lambda rows: spark.createDataFrame([_row(*r) for r in rows], SCHEMA).repartition(3)


WORDS = "alpha beta gamma delta Epsilon zeta. eta, theta été größer naïve 12 345 x y".split()


def prose(rng, n):
    """n words with several kinds of white space and some odd characters between them."""
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\n\n", "   ", " "]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, source): nulls, empty, blank and very long texts, repeats, near copies, ties and repeated rows."""
    rng = random.Random(7)
    shared, texts = prose(rng, 60), [prose(rng, rng.randrange(0, 120)) for _ in range(40)]
    texts += [shared + prose(rng, 20), prose(rng, 15) + shared, prose(rng, 5) + shared[: len(shared) // 2] + prose(rng, 9), shared, shared, shared + shared]
    texts += [None, None, "", " ", " ", "\n \n \n", "word", "one two", "tail \U0001f600 你好 世界", "<|endoftext|> a <|startoftext|>b", "\x00\x01 control", "a " * 30, "the same line\nthe same line\n \nthe same line", prose(rng, 8000), "loooong" * 3000, prose(rng, 40).replace(" ", "\n")]
    rows = [(i * 3 % 101, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id here " * 12, "s1"), (None, None, None)]


def as_rows(df, *columns):
    """Rows as tuples in an order of their own, for comparison."""
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


@pytest.fixture
def rows_of():
    return as_rows
