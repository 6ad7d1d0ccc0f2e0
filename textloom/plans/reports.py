"""Queries over terms, requests, evaluation runs, series and vectors, each with its SQL (None where SQL can't express it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import arrays, scores
from textloom.functions.text import words
from textloom.operators import analytics, lookup, metrics, reuse, sampling, serving, tokens
from textloom.operators.order import numbered
from textloom.plans.pairs import HASH, META, PAIRS, VALID, pairs, sql_words
from textloom.session import fresh_path
from textloom.sources import adapters
from textloom.sources.adapters import table
from textloom.streaming import corpus

TERMS = """terms AS (SELECT item_id AS term_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS source, array_to_string(string_split(text, ' ')[3:4], ' ') AS target, substr(text, 1, 40) AS note,
  ['general', 'tech', 'law', 'medicine', 'finance', 'science', 'other'][item_id % 7 + 1] AS category FROM benchmark)"""
RUNS = """runs AS (SELECT p_type AS dataset, p_brand AS model, sum(round(p_retailprice * 100)::BIGINT)::DOUBLE / count(p_retailprice) / 5000 AS quality,
  sum(p_size::BIGINT)::DOUBLE / count(p_size) AS latency, sum(p_size::BIGINT)::DOUBLE AS size FROM part GROUP BY ALL)"""
LOG = "log AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS loss FROM events)"
HYP = r"""lines AS (SELECT d.doc_id * 1000000 + t.i - 1 AS row_id, list_filter(string_split(d.l[t.i], ' '), lambda x: x <> '') AS r FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, unnest(range(1, len(d.l) + 1)) AS t(i)),
hyp_ref AS (SELECT row_id, r, list_filter(r, lambda x, i: NOT ends_with(md5(row_id::VARCHAR || ':' || (i - 1)::VARCHAR), '0')) AS h FROM lines WHERE len(r) > 0)"""
#: The words of the usual BLEU tokenisation, of lines in which "and" is an entity and "the" has a mark before it.
_APART = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || {c} || ' ', '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda x: x <> '')"""
_SAID = r"""replace(regexp_replace(regexp_replace(array_to_string({c}, ' '), '\band\b', '&amp;', 'g'), '\bthe\b', '、the', 'g'), '&amp;', '&')"""
TOKENS_13A = f"(SELECT row_id, {_APART.format(c=_SAID.format(c='h'))} AS h, {_APART.format(c=_SAID.format(c='r'))} AS r FROM hyp_ref)"


def bleu_sql(rows: str) -> str:
    return f"""WITH {HYP}, t AS (SELECT * FROM {rows}), g AS (SELECT row_id, n, side, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT row_id, h AS w, 1 AS side FROM t UNION ALL SELECT row_id, r, 0 FROM t) x, range(1, 5) o(n), unnest(range(1, len(w) - n + 2)) u(i)),
c AS (SELECT row_id, n, g, sum(side) AS a, sum(1 - side) AS b FROM g GROUP BY ALL), m AS (SELECT n, sum(least(a, b)) AS m, sum(a) AS t FROM c GROUP BY 1),
l AS (SELECT sum(len(h))::BIGINT AS sys_len, sum(len(r))::BIGINT AS ref_len FROM t), b AS (SELECT *, CASE WHEN sys_len >= ref_len THEN 1.0::DOUBLE ELSE exp(1 - ref_len / sys_len::DOUBLE) END AS bp FROM l)
SELECT round(bp * (SELECT exp(avg(ln(100.0::DOUBLE * m / t))) FROM m), 6) AS bleu, round(bp, 6) AS bp, sys_len, ref_len FROM b"""


#: Words from which one mark at the end, or else at the beginning, comes apart; n-grams of characters without white space, and of words.
CHRF = HYP.replace("lines AS", "WITH lines AS", 1) + r""",
marks AS (SELECT '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~' AS p),
s AS (SELECT row_id, r AS w, 0 AS side FROM hyp_ref UNION ALL SELECT row_id, h, 1 FROM hyp_ref),
items AS (
  SELECT row_id, side, 'c' AS kind, string_split(array_to_string(w, ''), '') AS x FROM s WHERE len(w) > 0
  UNION ALL
  SELECT row_id, side, 'w', flatten(list_transform(w, lambda v: CASE WHEN length(v) > 1 AND contains(p, v[-1]) THEN [v[:-2], v[-1]] WHEN length(v) > 1 AND contains(p, v[1]) THEN [v[1], v[2:]] ELSE [v] END)) FROM s, marks),
g AS (SELECT row_id, side, kind, n, array_to_string(x[i:i + n - 1], chr(1)) AS g FROM items, range(1, 7) o(n), unnest(range(1, len(x) - n + 2)) u(i) WHERE kind = 'c' OR n <= 2),
c AS (SELECT row_id, kind, n, g, sum(side) AS a, sum(1 - side) AS b FROM g GROUP BY ALL),
per_row AS (SELECT row_id, kind, n, sum(least(a, b)) AS m, sum(a) AS a, sum(b) AS b FROM c GROUP BY ALL),
per_order AS (SELECT kind, n, sum(m) AS m, sum(CASE WHEN b > 0 THEN a ELSE 0 END) AS a, sum(b) AS b FROM per_row GROUP BY ALL),
f AS (SELECT avg(m / a::DOUBLE) AS p, avg(m / b::DOUBLE) AS r FROM per_order WHERE a > 0 AND b > 0)
SELECT round(CASE WHEN p + r > 0 THEN 100.0::DOUBLE * 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf FROM f"""
COSINE = "list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)), lambda s, x: s + x)"
REQUESTS = "requests AS (SELECT event_id AS request_id, ts, user_id, event_type || ':' || user_id AS key, value AS latency, event_type FROM events), hits AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, request_id) > 1 AS hit FROM requests)"
#: Positions in the log, the use before of the same key, and the different keys in between.
DISTANCES = f"""{REQUESTS}, u AS (SELECT request_id, key, row_number() OVER (ORDER BY ts, request_id) AS pos FROM requests), b AS (SELECT *, lag(pos) OVER (PARTITION BY key ORDER BY pos) AS before FROM u),
d AS (SELECT a.request_id, any_value(a.before) AS before, CASE WHEN any_value(a.before) IS NOT NULL THEN count(DISTINCT u.key) END AS distance FROM b a LEFT JOIN u ON u.pos > a.before AND u.pos < a.pos GROUP BY a.request_id)"""
LRU = """count(*) AS requests, count(*) FILTER (distance < entries) AS hits, count(*) FILTER (distance IS NULL OR distance >= entries) AS misses,
greatest(count(*) FILTER (distance IS NULL OR distance >= entries) - entries, 0) AS evictions"""
CAPACITIES = [1, 10, 50, 100, 200, 400, 800]
#: All events as one series.
SERIES = "series AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS step, value AS loss FROM events)"
#: Requests that stay open for some minutes by their value: starts and ends, in microseconds.
OPEN = "o AS (SELECT event_type, event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + 1 + round(value * 1000)::BIGINT * 60000 AS b FROM events)"


def _lru(s, d, capacities):
    return reuse.lru_curve(reuse.reuse_distances(_requests(s, d), "key", ["ts", "request_id"]), capacities)


def _series(s, d):
    """All events as one series."""
    return numbered(table(s, d, "events").select("ts", "event_id", F.col("value").alias("loss")), "ts", "event_id", name="step").withColumn("run", F.lit("all"))


def _open(s, d, *columns):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(s, d, "events").select("event_type", *columns, start.alias("a"), (start + 1 + F.round(F.col("value") * 1000).cast("long") * 60000).alias("b"))


def _terms(s, d):
    return adapters.terms(table(s, d, "benchmark"))


def _requests(s, d):
    return adapters.requests(table(s, d, "events"))


def _log(s, d):
    return adapters.loss_log(table(s, d, "events"))


def _runs(s, d):
    return adapters.eval_runs(table(s, d, "part"))


def _hyp_ref(s, d):
    return adapters.hyp_ref(table(s, d, "documents"))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _matches(s, d):
    rows = table(s, d, "conversations").select("conv_id", "turn", "text")
    return lookup.match_terms(rows, _terms(s, d))


def _prompts(s, d):
    rows = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return lookup.glossary_prompt(lookup.match_terms(rows, _terms(s, d)), "id")


def _prefixes(s, d):
    """Lines against a cache of the beginnings, of 5 to 24 characters, of what follows lines."""
    lines = pairs(s, d).select("pair_id", "src", "tgt")
    cache = lines.groupBy(F.expr("substring(tgt, 1, CAST(5 + pair_id % 20 AS INT))").alias("prefix")).agg(F.min("pair_id").alias("value"))
    return lookup.longest_prefix(lines, cache, "pair_id", "src")


def _exact(s, d):
    cache = table(s, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.min("doc_id").alias("value"))
    return lookup.exact_lookup(table(s, d, "documents").select("doc_id", "text"), cache).select("doc_id", "value")


def _histogram(s, d):
    return analytics.histogram(pairs(s, d).select(F.length("src").cast("double").alias("n")), "n").withColumn("n", F.col("n").cast("long"))


def _good(s, d):
    return sampling.with_metadata(sampling.prefiltered(pairs(s, d)))


def _vectors(s, d):
    return table(s, d, "embeddings")


def _cosine_pairs(s, d):
    v = _vectors(s, d)
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(w, "vec_id").select("vec_id", F.round(arrays.dot(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def _quantized(s, d):
    low, high = (f(F.transform("embedding", lambda x: x.cast("double"))) for f in (F.array_min, F.array_max))
    rows = _vectors(s, d).select("vec_id", "embedding", low.alias("low"), high.alias("high"))
    q = F.transform("embedding", lambda x: arrays.int4(x.cast("double"), F.col("low"), F.col("high")))
    return rows.select("vec_id", F.aggregate(q, F.lit(0), lambda a, x: a + x).cast("long").alias("sum"), F.array_min(q).alias("low"), F.array_max(q).alias("high"))


def _bootstrap(s, d):
    rows = adapters.pairs_conversations(table(s, d, "conversations"))
    scored = rows.select("pair_id", (F.length("src") % 100 / 100.0).alias("a"), (F.length("src") % 100 / 100.0 + F.length("tgt") % 7 / 100.0 - 0.02).alias("b"))
    scored = numbered(scored, "pair_id")
    return _rounded(metrics.paired_bootstrap(scored, "pos", "a", "b", 100), "observed", "p")


def _bleu(s, d):
    rows = _hyp_ref(s, d)
    return _rounded(metrics.corpus_bleu(rows, F.col("hyp"), F.col("ref")), "bleu", "bp").drop("precisions")


def _bleu_13a(s, d):
    rows = _marked(s, d)
    return _rounded(metrics.corpus_bleu(rows, F.col("hyp"), F.col("ref"), split=metrics.split_13a), "bleu", "bp").drop("precisions")


def _marked(s, d):
    """hyp_ref() with an entity in place of each plain "and", and a mark of Chinese punctuation before each "the"."""
    odd = lambda c: F.regexp_replace(F.regexp_replace(c, r"\band\b", "&amp;"), r"\bthe\b", "、the")
    return _hyp_ref(s, d).withColumns({c: odd(F.col(c)) for c in ("hyp", "ref")})


def _evaluated(s, d):
    rows = _hyp_ref(s, d).withColumn("comet", F.length("hyp") / F.length("ref"))
    return _rounded(metrics.evaluate(rows, ("ter", "wer", "comet")), "ter", "wer", "comet").select("ter", "wer", "comet", F.col("bertscore").isNull().alias("no_bertscore"))


def _events_folder(s, d) -> DataFrame:
    return s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")


def _stream_stats(s, d):
    out, point = fresh_path(s, "rolling"), fresh_path(s, "rolling-checkpoint")
    # Complete windows only leave the state when time has passed them, so a finite log is summed in update-free batches.
    stream = corpus.rolling_stats(_events_folder(s, d), late="0 seconds")
    query = stream.writeStream.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", point).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = s.read.parquet(out)
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "mean"), "batch").alias("x"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "x.n", F.round("x.mean", 6).alias("mean"))


def _stream_dedup(s, d):
    """Cleaned pairs by a stream over files of pairs; the same as the batch query's count."""
    lines, out, point = fresh_path(s, "stream-in"), fresh_path(s, "stream-out"), fresh_path(s, "stream-checkpoint")
    pairs(s, d).select(F.col("src").alias("chinese"), F.col("tgt").alias("english"), "source").write.json(lines)
    corpus.run_available(corpus.clean(corpus.read_pairs(s, lines, 2)), out, point)
    return s.read.parquet(out).agg(F.count("*").alias("n"), F.sum(F.length("src")).alias("chars"))


QUERIES = {
    "term_match": (
        lambda s, d: _matches(s, d).select("conv_id", "turn", "term_id"),
        f"WITH {TERMS} SELECT conv_id, turn, term_id FROM conversations c JOIN terms t ON contains(c.text, t.source) OR contains(c.text, t.target)",
    ),
    "term_prompt": (
        _prompts,
        f"""WITH {TERMS} SELECT conv_id * 1000 + turn AS id, string_agg('"' || source || '" → "' || target || '"', chr(10) ORDER BY term_id) AS prompt FROM conversations c JOIN terms t ON contains(c.text, t.source) OR contains(c.text, t.target) GROUP BY 1""",
    ),
    "term_search": (
        lambda s, d: lookup.search_terms(_terms(s, d), "er", "tech").select("term_id", "category"),
        f"WITH {TERMS} SELECT term_id, category FROM terms WHERE (contains(source, 'er') OR contains(target, 'er') OR contains(note, 'er')) AND category = 'tech'",
    ),
    "cache_exact_hits": (
        lambda s, d: serving.first_seen_hits(_requests(s, d), "key", "ts", "request_id").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")),
        f"WITH {REQUESTS} SELECT event_type, count(*) AS n, count(*) FILTER (hit) AS hits FROM hits GROUP BY 1",
    ),
    "cache_exact_lookup": (_exact, "WITH c AS (SELECT md5(text) AS k, min(doc_id) AS value FROM documents GROUP BY 1) SELECT doc_id, value FROM documents LEFT JOIN c ON md5(text) = k"),
    "cache_prefix_lookup": (
        _prefixes,
        f"WITH {PAIRS}, c AS (SELECT substr(tgt, 1, 5 + pair_id % 20) AS prefix, min(pair_id) AS value FROM pairs GROUP BY 1), n AS (SELECT pair_id, substr(src, 1, k) AS prefix FROM pairs, range(1, 25) r(k) WHERE length(src) >= k) SELECT pair_id, prefix, value FROM n JOIN c USING (prefix) QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY length(prefix) DESC) = 1",
    ),
    "cache_lru_sim": (lambda s, d: _lru(s, d, [200]).withColumn("cache", F.lit("all")).drop("entries"), f"WITH {DISTANCES}, c AS (SELECT 200 AS entries) SELECT 'all' AS cache, {LRU} FROM d, c GROUP BY entries"),
    "cache_miss_curve": (lambda s, d: _lru(s, d, CAPACITIES), f"WITH {DISTANCES}, c AS (SELECT unnest({CAPACITIES}) AS entries) SELECT entries, {LRU} FROM d, c GROUP BY entries"),
    "cache_reuse_distances": (
        lambda s, d: reuse.reuse_distances(_requests(s, d), "key", ["ts", "request_id"]).select("request_id", "before", "distance"),
        f"WITH {DISTANCES} SELECT request_id, before, distance FROM d",
    ),
    "service_stats": (
        lambda s, d: _rounded(analytics.service_stats(serving.first_seen_hits(_requests(s, d), "key", "ts", "request_id"), "hit", "latency"), "hit_rate", "avg_latency"),
        f"WITH {REQUESTS} SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS hit_rate, round(avg(latency) FILTER (NOT hit), 6) AS avg_latency FROM hits",
    ),
    "request_history_top50": (
        lambda s, d: serving.history(_requests(s, d), "ts", "request_id").select("request_id", "key"),
        "SELECT event_id AS request_id, event_type || ':' || user_id AS key FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    ),
    "token_stats": (
        lambda s, d: _rounded(tokens.token_report(words(F.col("text")), table(s, d, "documents")), "mean"),
        f"SELECT count(*) AS texts, sum({sql_words('text')})::BIGINT AS tokens, round(avg({sql_words('text')}), 6) AS mean, min({sql_words('text')}) AS least, max({sql_words('text')}) AS most FROM documents",
    ),
    "word_freq_top30": (
        lambda s, d: tokens.word_frequencies(table(s, d, "documents"), "text"),
        r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1 ORDER BY n DESC, w LIMIT 30",
    ),
    "length_histogram": (
        _histogram,
        f"WITH {PAIRS}, x AS (SELECT length(src)::DOUBLE AS v FROM pairs), e AS (SELECT min(v) AS a, max(v) AS b FROM x) SELECT least(floor((v - a) / (b - a) * 50), 49)::INT AS bin, count(*) AS n FROM x, e GROUP BY 1",
    ),
    "boxplot_stats": (
        lambda s, d: _rounded(analytics.box_stats(_good(s, d), "similarity_score", "difficulty"), "q1", "median", "q3", "low_whisker", "high_whisker"),
        f"""WITH {META}, q AS (SELECT difficulty, quantile_cont(similarity_score, 0.25) AS q1, quantile_cont(similarity_score, 0.5) AS median, quantile_cont(similarity_score, 0.75) AS q3 FROM meta GROUP BY 1)
SELECT difficulty, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(similarity_score), 6) AS low_whisker, round(max(similarity_score), 6) AS high_whisker
FROM meta JOIN q USING (difficulty) WHERE similarity_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY difficulty, q1, median, q3""",
    ),
    "threshold_counts": (
        lambda s, d: analytics.threshold_counts(_good(s, d), "similarity_score", 0.75),
        f"WITH {META} SELECT count(*) FILTER (similarity_score >= 0.75::DOUBLE) AS kept, count(*) FILTER (similarity_score < 0.75::DOUBLE) AS filtered FROM meta",
    ),
    "source_shares": (lambda s, d: _rounded(analytics.shares(table(s, d, "documents"), "lang"), "percent"), "SELECT lang AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY 1"),
    "size_ratios": (
        lambda s, d: _rounded(analytics.size_ratios(_runs(s, d), "size", "dataset").select("dataset", "model", "compression", "width"), "compression", "width"),
        f"WITH {RUNS} SELECT dataset, model, round(max(size) OVER (PARTITION BY dataset) / size, 6) AS compression, round(size * 100 / max(size) OVER (PARTITION BY dataset), 6) AS width FROM runs",
    ),
    "domain_pivot": (
        lambda s, d: analytics.domain_pivot(table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v")), "user_id", "event_type", "v", ["click", "error", "purchase"]),
        "SELECT user_id, " + ", ".join(f"coalesce(round(avg(value) FILTER (event_type = '{t}'), 6), 0) AS {t}" for t in ("click", "error", "purchase")) + " FROM events GROUP BY 1",
    ),
    "efficiency_rank": (
        lambda s, d: _rounded(analytics.efficiency(_runs(s, d), "quality", "latency", "size").select("dataset", "model", "score"), "score"),
        f"WITH {RUNS}, b AS (SELECT max(quality) AS q, min(latency) AS l, min(size) AS s FROM runs) SELECT dataset, model, round(quality / q * 60 + l / latency * 20 + s / size * 20, 6) AS score FROM runs, b",
    ),
    "radar_normalize": (
        lambda s, d: _rounded(analytics.radar(_runs(s, d), "dataset", "quality", "latency", "size").select("dataset", "model", "quality_share", "speed_share", "compact_share"), "quality_share", "speed_share", "compact_share"),
        f"WITH {RUNS} SELECT dataset, model, round(quality * 100 / max(quality) OVER w, 6) AS quality_share, round(1000 / latency * 100 / max(1000 / latency) OVER w, 6) AS speed_share, round(1000 / size * 100 / max(1000 / size) OVER w, 6) AS compact_share FROM runs WINDOW w AS (PARTITION BY dataset)",
    ),
    "pareto_frontier": (
        lambda s, d: analytics.pareto(_runs(s, d), "dataset", "latency", "quality", "model").select("dataset", "model", "latency", "quality"),
        f"WITH {RUNS} SELECT dataset, model, latency, quality FROM runs QUALIFY quality > coalesce(max(quality) OVER (PARTITION BY dataset ORDER BY latency, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)",
    ),
    "cosine_pairs": (_cosine_pairs, "SELECT a.vec_id, round(" + COSINE.format(a="a.embedding", b="b.embedding") + ", 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "embedding_importance_topk": (
        lambda s, d: _rounded(analytics.top_mask(analytics.dimension_importance(_vectors(s, d), "embedding"), 0.7), "importance"),
        "WITH x AS (SELECT generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), i AS (SELECT pos::INT AS pos, sum(abs(x)) AS importance FROM x GROUP BY 1) SELECT pos, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, pos) <= greatest(1, floor(count(*) OVER () * (1 - 0.7::DOUBLE))) AS kept FROM i",
    ),
    "checkpoint_average": (
        lambda s, d: _rounded(analytics.checkpoint_average(_vectors(s, d), "vec_id", "embedding", 10), "value"),
        "WITH v AS (SELECT embedding FROM embeddings ORDER BY vec_id DESC LIMIT 10), x AS (SELECT generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM v) SELECT pos::INT AS pos, round(avg(x), 6) AS value FROM x GROUP BY 1",
    ),
    "weighted_ensemble": (
        lambda s, d: _rounded(analytics.weighted_ensemble(_vectors(s, d).withColumn("w", F.col("vec_id") % 5 + 1.0), "label", "embedding", "w"), "value"),
        "WITH x AS (SELECT label, vec_id % 5 + 1.0::DOUBLE AS w, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, pos::INT AS pos, round(sum(w * x) / sum(w), 6) AS value FROM x GROUP BY ALL",
    ),
    "int4_quantize": (
        _quantized,
        """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), r AS (SELECT vec_id, e, list_min(e) AS a, (list_max(e) - list_min(e)) / 15 AS s FROM x),
q AS (SELECT vec_id, list_transform(e, lambda v: greatest(least(round_even(v / s + (-8 - a / s), 0), 7), -8)::INT) AS q FROM r) SELECT vec_id, list_sum(q)::BIGINT AS sum, list_min(q) AS low, list_max(q) AS high FROM q""",
    ),
    "ema_loss": (
        lambda s, d: _rounded(analytics.smoothed(_log(s, d), "run", "step", "loss"), "smoothed"),
        f"WITH {LOG}, l AS (SELECT run, step, list(loss) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS v FROM log) SELECT run, step, round(list_reduce(list_prepend(v[1], v), lambda a, x: a * 0.9::DOUBLE + x * (1 - 0.9::DOUBLE)), 6) AS smoothed FROM l",
    ),
    "running_mean_loss": (
        lambda s, d: _rounded(analytics.running_mean(_log(s, d), "run", "step", "loss").select("run", "step", "running_mean"), "running_mean", digits=9),
        f"WITH {LOG} SELECT run, step, round(avg(loss) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM log",
    ),
    "best_so_far": (
        lambda s, d: analytics.best_so_far(_log(s, d), "run", "step", "loss"),
        f"WITH {LOG} SELECT run, step, loss FROM log QUALIFY loss < coalesce(min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE)",
    ),
    "ema_one_series": (
        lambda s, d: _rounded(analytics.smoothed(_series(s, d), "run", "step", "loss", 0.999).select("step", "smoothed"), "smoothed"),
        f"""WITH {SERIES}, w AS (SELECT step, loss, first(loss) OVER (ORDER BY step) AS head, sum(loss * 0.001::DOUBLE * pow(0.999::DOUBLE, -step)) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) AS part FROM series)
SELECT step, round(pow(0.999::DOUBLE, step) * (head + part), 6) AS smoothed FROM w""",
    ),
    "running_mean_one_series": (
        lambda s, d: _rounded(analytics.running_mean(_series(s, d), "run", "step", "loss").select("step", "running_mean"), "running_mean", digits=9),
        f"WITH {SERIES} SELECT step, round(avg(loss) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM series",
    ),
    "best_of_one_series": (
        lambda s, d: analytics.best_so_far(_series(s, d), "run", "step", "loss").select("step", "loss"),
        f"WITH {SERIES} SELECT step, loss FROM series QUALIFY loss < coalesce(min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE)",
    ),
    "peak_concurrency": (
        lambda s, d: analytics.peak_concurrency(_open(s, d), "a", "b", "event_type"),
        f"WITH {OPEN}, e AS (SELECT event_type, a AS t, 1 AS d FROM o UNION ALL SELECT event_type, b, -1 FROM o) SELECT event_type, max(n)::BIGINT AS peak FROM (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM e) GROUP BY 1",
    ),
    "peak_concurrency_all": (
        lambda s, d: analytics.peak_concurrency(_open(s, d), "a", "b"),
        f"WITH {OPEN}, e AS (SELECT a AS t, 1 AS d FROM o UNION ALL SELECT b, -1 FROM o) SELECT max(n)::BIGINT AS peak FROM (SELECT sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM e)",
    ),
    "loss_extremes": (
        lambda s, d: analytics.extremes(_log(s, d), "run", "step", "loss"),
        f"WITH {LOG} SELECT run, min(loss) AS low, arg_min(step, (loss, step)) AS low_step, max(loss) AS high, arg_max(step, (loss, -step)) AS high_step FROM log GROUP BY 1",
    ),
    "last_losses": (
        lambda s, d: analytics.last_n(_log(s, d), "run", "step", 10),
        f"WITH {LOG} SELECT run, step, loss FROM log QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 10",
    ),
    "grad_accum_groups": (
        lambda s, d: _rounded(analytics.accumulation_groups(_log(s, d), "run", "step", "loss", 4), "mean"),
        f"WITH {LOG} SELECT run, (step - 1) // 4 AS update, round(avg(loss), 6) AS mean FROM log GROUP BY ALL HAVING count(*) = 4",
    ),
    "spaced_axis": (
        lambda s, d: _rounded(analytics.spaced_axis(_log(s, d), "run", "step", 100.0).select("run", "step", "x"), "x"),
        f"WITH {LOG} SELECT run, step, round(CASE WHEN max(step) OVER w > 1 THEN (step - 1) * 100.0::DOUBLE / (max(step) OVER w - 1) ELSE 0 END, 6) AS x FROM log WINDOW w AS (PARTITION BY run)",
    ),
    "noam_schedule": (
        lambda s, d: s.range(1, 8001).select(F.col("id").alias("step"), F.round(scores.noam_rate(F.col("id")), 12).alias("rate")),
        "SELECT range AS step, round(512::DOUBLE ** -0.5::DOUBLE * least(1 / sqrt(range::DOUBLE), range::DOUBLE * 4000::DOUBLE ** -1.5::DOUBLE), 12) AS rate FROM range(1, 8001)",
    ),
    "bleu_corpus": (
        _bleu,
        bleu_sql("hyp_ref"),
    ),
    "bleu_13a": (_bleu_13a, bleu_sql(TOKENS_13A)),
    "chrf_corpus": (lambda s, d: _rounded(metrics.corpus_chrf(_hyp_ref(s, d)), "chrf"), CHRF),
    "ter_corpus": (lambda s, d: _rounded(metrics.corpus_ter(_hyp_ref(s, d)), "ter"), f"WITH {HYP} SELECT sum(len(r) - len(h))::BIGINT AS edits, sum(len(r))::BIGINT AS ref_words, round(sum(len(r) - len(h)) * 100.0::DOUBLE / sum(len(r)), 6) AS ter FROM hyp_ref"),
    "evaluate_report": (
        _evaluated,
        f"""WITH {HYP}, x AS (SELECT r, h, length(array_to_string(h, ' ')) / length(array_to_string(r, ' '))::DOUBLE AS c FROM hyp_ref)
SELECT round(sum(len(r) - len(h)) * 100.0::DOUBLE / sum(len(r)), 6) AS ter, round(sum(len(r) - len(h)) * 100.0::DOUBLE / sum(len(r)), 6) AS wer, round(avg(c), 6) AS comet, true AS no_bertscore FROM x""",
    ),
    "wer_corpus": (
        lambda s, d: _rounded(metrics.corpus_wer(_hyp_ref(s, d), F.col("hyp"), F.col("ref")), "wer"),
        # Hypotheses are references without some words, so the edits are the words that are missing.
        f"WITH {HYP} SELECT sum(len(r) - len(h))::BIGINT AS edits, sum(len(r))::BIGINT AS ref_words, round(sum(len(r) - len(h)) * 100.0::DOUBLE / sum(len(r)), 6) AS wer FROM hyp_ref",
    ),
    "paired_bootstrap": (
        _bootstrap,
        """WITH c AS (SELECT conv_id * 1000000 + turn AS pair_id, text AS src, role, lead(role) OVER w AS nr, lead(text) OVER w AS tgt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT row_number() OVER (ORDER BY pair_id) AS pos, (length(src) % 100 / 100.0::DOUBLE + length(tgt) % 7 / 100.0::DOUBLE - 0.02::DOUBLE) - length(src) % 100 / 100.0::DOUBLE AS d FROM c WHERE role = 'user' AND nr = 'assistant'),
n AS (SELECT count(*) AS n, avg(d) AS observed FROM x), draws AS (SELECT r, ('0x' || substr(md5('42:' || r || ':' || k), 1, 12))::BIGINT % n + 1 AS pos FROM n, range(1, 101) a(r), range(1, n + 1) b(k)),
m AS (SELECT r, avg(d) AS d FROM draws JOIN x USING (pos) GROUP BY 1) SELECT (SELECT n FROM n) AS n, round((SELECT observed FROM n), 6) AS observed, round(avg((d <= 0)::INT), 6) AS p FROM m""",
    ),
    "stream_rolling_stats": (_stream_stats, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL"),
    "stream_dedup_counts": (
        _stream_dedup,
        f"WITH {VALID}, u AS (SELECT any_value(src) AS src FROM valid GROUP BY {HASH}) SELECT count(*) AS n, sum(length(src))::BIGINT AS chars FROM u",
    ),
}
