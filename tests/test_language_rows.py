"""Scores of languages, whose trigrams are never rows."""

from pyspark.sql import functions as F

from textloom.operators import language


def test_scores_are_sums_of_weights(spark, capsys):
    rows = spark.createDataFrame([(1, "the cat", "en"), (2, "der Hund", "de"), (3, "12 !", None), (4, None, None), (5, "The hut", None)], "doc_id long, text string, lang string")
    model = language.train(rows)
    found = language.score(rows, model)
    weights = {r.gram: r.w for r in model.weights.collect()}
    want = {}
    for r in rows.collect():
        words = [f" {w} " for w in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()]
        grams = [w[i : i + 3] for w in words for i in range(len(w) - 2)]
        s = sorted((-sum(weights.get(g, model.unknown)[i] for g in grams), x) for i, x in enumerate(model.languages))
        want[r.doc_id] = (len(grams), s[0][1] if grams else None, s[1][0] - s[0][0] if grams else 0)
    assert {r.doc_id: (r.grams, r.language, r.margin) for r in found.collect()} == want
    found.filter(F.lit(True)).explain()
    assert "Generate" not in capsys.readouterr().out
