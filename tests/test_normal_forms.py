"""Texts that need no Python for their normal form."""

import re
import unicodedata

from pyspark.sql import functions as F

from textloom.functions import text


def test_characters_that_stay_in_the_jvm_are_their_own_normal_form():
    plain = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08X}", text.ODD))
    kept = [chr(i) for i in range(0x110000) if not plain.match(chr(i))]
    assert len(kept) > 21_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in kept)


def test_python_gets_no_other_texts(spark):
    """Rows that are their own normal form are null for the function of Python."""
    texts = ["plain", "déjà vu", "汉字", "ﬁn", "e\u0301", None, "１２"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("n", text.normalize_nfkc(F.col("t")))
    assert [r.n for r in rows.orderBy("i").collect()] == [t and unicodedata.normalize("NFKC", t) for t in texts]
    sent = [bool(t) and re.search(r"[^\x00-\x7Fé\u00e0汉字]", t) is not None for t in texts]
    assert [bool(r.odd) for r in rows.select("i", F.col("t").rlike(text.ODD).alias("odd")).orderBy("i").collect()] == sent
