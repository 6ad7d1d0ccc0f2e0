"""Queries over functions of texts, scores and arrays, lookups, reports and files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import arrays, scores, text
from textloom.operators import analytics, augment, cleaning, filtering, lookup, metrics, serving, tokens
from textloom.operators.order import numbered
from textloom.plans.pairs import CLEANED, FILTERED, PAIRS, REASON, pairs, sql_space, sql_words
from textloom.plans.reports import LOG, RUNS
from textloom.plans.reports import _log as log
from textloom.plans.reports import _rounded as rounded
from textloom.plans.reports import _runs as runs
from textloom.session import fresh_path
from textloom.sources import readers
from textloom.sources.adapters import table
from textloom.streaming import corpus

URL = r"https?://(?:[-\p{L}\p{N}_.]|(?:%[0-9a-fA-F]{2}))+[/\p{L}\p{N}_\-.~:?#\[\]@!$&''()*+,;=%]*"
EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


def _chain(c: str) -> str:
    """All steps of cleaning but NFKC, in which the test tables are already."""
    out = f"regexp_replace({c}, '<[^>]+>', '', 'g')"
    for entity, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)")):
        out = f"replace({out}, '{entity}', {char})"
    for pattern in (URL, EMAIL, CONTROL):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return sql_space(out)


#: A text without characters of category C.
BARE = r"regexp_replace(text, '\p{C}', '', 'g')"


def _scripts(s, d):
    c = F.col("text")
    return table(s, d, "documents").select("doc_id", text.contains_han(c).alias("han"), text.mostly_han(c).alias("mostly"), F.size(text.tokens(c)).cast("long").alias("tokens"), text.prefix(c).alias("prefix"), text.preview(c, 20).alias("preview"))


def _times(s, d):
    seconds = F.col("event_id") * 7 + 0.013  # never half of what is shown
    return table(s, d, "events").select("event_id", text.format_time(seconds).alias("told"), text.clock(seconds).alias("clock"))


def _cross_entropy(s, d):
    """Vectors as logits of 64 classes."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(s, d, "embeddings").select("vec_id", x.alias("x"))
    total = F.log(F.aggregate(F.transform("x", lambda v: F.exp(v)), F.lit(0.0), lambda a, v: a + v))
    rows = rows.withColumn("total", total).select("vec_id", F.transform("x", lambda v: v - F.col("total")).alias("logs"))
    return rows.select("vec_id", F.round(arrays.smoothed_cross_entropy(F.col("logs"), (F.col("vec_id") % 64).cast("int")), 6).alias("loss"))


def _padded(s, d):
    """Lengths of words as ids, in batches of 16 places."""
    ids = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.length(w))
    rows = table(s, d, "documents").select("doc_id", ids.alias("ids"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("long")
    return rows.select("doc_id", total(arrays.padded(F.col("ids"), 16)).alias("sum_ids"), total(arrays.attention_mask(F.col("ids"), 16)).alias("sum_mask"), total(arrays.labels(F.col("ids"), 16)).alias("sum_labels"))


def _swapped(s, d):
    rows = pairs(s, d).select("pair_id", F.filter(F.split("src", " "), lambda w: w != "").alias("w"))
    return rows.select("pair_id", F.array_join(augment.swap_words(F.col("w"), F.col("pair_id"), 0.5), " ").alias("text"))


def _back_translated(s, d):
    """A stand-in for a model: the beginning of the text, and its length as a score."""
    return augment.back_translate(pairs(s, d), lambda texts: [(t[:5], len(t) / 100) for t in texts], keep=("pair_id", "source"))


def _stream_filtered(s, d):
    """The batch filters on a stream of JSON lines, and what came through by difficulty."""
    lines, out, point = (fresh_path(s, x) for x in ("filter-in", "filter-out", "filter-checkpoint"))
    pairs(s, d).select(F.col("src").alias("chinese"), F.col("tgt").alias("english"), "source").write.json(lines)
    corpus.run_available(corpus.filtered(corpus.read_pairs(s, lines, 2)), out, point)
    return s.read.parquet(out).groupBy("difficulty").agg(F.count("*").alias("n"), F.sum(F.length("src")).alias("chars"))


def _preprocessed(s, d):
    return tokens.preprocess_pairs(pairs(s, d)).select("pair_id", "src", "tgt")


def _two_windows(s, d):
    """Pairs in the window of lengths, also after encoding: here by words, as a caller's tokenizer would."""
    rows = tokens.preprocess_encoded(pairs(s, d), lambda: lambda texts: [[len(w) for w in t.split()] for t in texts], least=3, most=20)
    return rows.select("pair_id", F.size("src_ids").cast("long").alias("src_tokens"), F.size("tgt_ids").cast("long").alias("tgt_tokens"))


def _joined_lines(s, d):
    """The first line of each document with the title of the page at the same place."""
    left = numbered(table(s, d, "documents").select("doc_id", F.split("text", "\n")[0].alias("line")), "doc_id")
    right = numbered(table(s, d, "pages").select("page_id", "url"), "page_id")
    return lookup.positional(left, right).select("pos", "doc_id", "page_id")


def _not_sampled(s, d):
    rows = pairs(s, d).select("pair_id")
    return lookup.without(rows, filtering.ratio_filter(pairs(s, d)), "pair_id").agg(F.count("*").alias("n"), F.sum("pair_id").cast("long").alias("sum_id"))


def _with_default(s, d):
    quality = table(s, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return lookup.with_default(table(s, d, "documents").select("doc_id", "lang"), quality, "doc_id", "quality", -1.0)


def _misses(s, d):
    known = table(s, d, "benchmark").select(F.explode(F.split("text", "")).alias("char")).distinct()
    return lookup.vocabulary_misses(F.col("text"), known, table(s, d, "documents"), "doc_id")


def _responses(s, d):
    messages = table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"))
    return serving.responses(messages).select("conv_id", "turn", "error")


def _density(s, d):
    x = table(s, d, "embeddings").select(F.explode("embedding").alias("x")).select(F.col("x").cast("double").alias("x"))
    return rounded(analytics.density(x, "x"), "share", digits=9)


def _parameters(s, d):
    rows = table(s, d, "part").select(F.col("p_size").cast("long").alias("n"), (F.col("p_partkey") % 3 > 0).alias("trainable"))
    return rounded(analytics.parameter_counts(rows, "n", "trainable"), "mb")


def _tiers(s, d):
    tier = analytics.memory_tier(F.col("p_size").cast("double"))
    return table(s, d, "part").select("p_partkey", tier["batch"].cast("long").alias("batch"), tier["concurrency"].cast("long").alias("concurrency"))


def _aligned(s, d):
    """Lines of documents as two folders of files, and read again line by line."""
    paths = [fresh_path(s, name) for name in ("left", "right")]
    rows = numbered(pairs(s, d).select("pair_id", F.trim("src").alias("src"), F.trim("tgt").alias("tgt")).filter("src <> '' AND tgt <> ''"), "pair_id")
    # Files in the order of their names, none of which is a task's alone.
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    for side, path in zip(("src", "tgt"), paths):
        rows.select("pos", side).repartitionByRange(parts, "pos").sortWithinPartitions("pos").select(side).write.text(path)
    read = readers.read_aligned_text(s, *paths)
    return read.agg(F.count("*").alias("n"), F.sum(F.col("pos") * F.length("src")).cast("long").alias("left"), F.sum(F.col("pos") * F.length("tgt")).cast("long").alias("right"))


def _csv_pairs(s, d):
    path = fresh_path(s, "csv")
    table(s, d, "part").select("p_name", "p_type").write.csv(path)
    return readers.read_csv_pairs(s, path).groupBy("tgt").agg(F.count("*").alias("n"))


def _folder(s, d):
    """JSON lines in two folders of files, read as one with the rows of each kind."""
    path = fresh_path(s, "folder")
    table(s, d, "documents").select(F.col("lang").alias("chinese"), F.col("source").alias("english")).write.json(path)
    return readers.read_directory(s, path).groupBy("src", "tgt").agg(F.count("*").alias("n"))


def _reasons(s, d):
    counts = cleaning.reason_counts(cleaning.validated(cleaning.normalized(pairs(s, d))))
    return cleaning.non_zero(counts, "n")


def _flags(s, d):
    rows = runs(s, d)
    return rows.select("dataset", "model", metrics.target_flags(F.col("quality") * 100, F.col("latency") / 40).alias("met"), F.round(scores.confidence(-F.col("quality")), 6).alias("confidence"))


QUERIES = {
    "augment_swap_words": (
        _swapped,
        f"""WITH {PAIRS}, w AS (SELECT pair_id, list_filter(string_split(src, ' '), lambda x: x <> '') AS w FROM pairs),
u AS (SELECT *, floor(('0x' || substr(md5(pair_id || ':at'), 1, 8))::BIGINT / 4294967296::DOUBLE * (len(w) - 1))::BIGINT AS a, ('0x' || substr(md5(pair_id || ':swap'), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM w)
SELECT pair_id, array_to_string(CASE WHEN len(w) >= 2 AND u < 0.5::DOUBLE THEN list_concat(list_concat(w[1:a], [w[a + 2], w[a + 1]]), w[a + 3:]) ELSE w END, ' ') AS text FROM u""",
    ),
    "back_translated": (_back_translated, f"WITH {PAIRS} SELECT pair_id, source, substr(tgt, 1, 5) AS src, tgt, length(tgt) / 100::DOUBLE AS confidence FROM pairs"),
    "stream_filtered_counts": (_stream_filtered, f"WITH {FILTERED} SELECT difficulty, count(*) AS n, sum(length(src))::BIGINT AS chars FROM filtered GROUP BY 1"),
    "strip_urls_control": (
        lambda s, d: table(s, d, "documents").select("doc_id", text.strip_control(text.strip_urls(F.col("text"))).alias("text")),
        f"SELECT doc_id, regexp_replace(regexp_replace(text, '{URL}', '', 'g'), '{CONTROL}', '', 'g') AS text FROM documents",
    ),
    "clean_text_pages": (lambda s, d: table(s, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("text")), f"SELECT page_id, {_chain('html')} AS text FROM pages"),
    "clean_text_docs": (lambda s, d: table(s, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text")), f"SELECT doc_id, {_chain('text')} AS text FROM documents"),
    "wmt_normalize_docs": (
        lambda s, d: table(s, d, "documents").select("doc_id", text.wmt_normalize(F.col("text")).alias("spaced"), text.wmt_normalize(F.col("text"), spaced=False).alias("bare")),
        rf"SELECT doc_id, {sql_space(BARE)} AS spaced, regexp_replace({BARE}, '\s+', '', 'g') AS bare FROM documents",
    ),
    "script_tokens": (
        _scripts,
        f"""WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[一-鿿]')) AS han FROM documents), m AS (SELECT *, han > 0.3::DOUBLE * length(text) AS mostly FROM c)
SELECT doc_id, han > 0 AS han, mostly, CASE WHEN mostly THEN length(replace(text, ' ', '')) ELSE {sql_words('text')} END AS tokens, substr(text, 1, 50) AS prefix, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS preview FROM m""",
    ),
    "told_times": (
        _times,
        "WITH x AS (SELECT event_id, event_id * 7 + 0.013::DOUBLE AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS told, printf('%02d:%02d:%02d', trunc(s)::BIGINT // 3600, trunc(s)::BIGINT % 3600 // 60, trunc(s)::BIGINT % 60) AS clock FROM x",
    ),
    "smoothed_cross_entropy": (
        _cross_entropy,
        "WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), l AS (SELECT *, x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS l FROM x) SELECT vec_id, round(-sum(l * CASE WHEN i = vec_id % 64 THEN 0.9::DOUBLE WHEN i = 0 THEN 0 ELSE 0.1::DOUBLE / 62 END), 6) AS loss FROM l GROUP BY 1",
    ),
    "loss_perplexity": (
        lambda s, d: rounded(analytics.perplexity(log(s, d).withColumn("loss", F.col("loss") / 100), "loss", "run"), "perplexity"),
        f"WITH {LOG} SELECT run, round(exp(avg(loss / 100)), 6) AS perplexity FROM log GROUP BY 1",
    ),
    "padded_batches": (
        _padded,
        "WITH x AS (SELECT doc_id, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w))[1:16] AS ids FROM documents) SELECT doc_id, coalesce(list_sum(ids), 0)::BIGINT AS sum_ids, len(ids) AS sum_mask, (coalesce(list_sum(ids), 0) - 100 * (16 - len(ids)))::BIGINT AS sum_labels FROM x",
    ),
    "preprocess_pairs": (
        _preprocessed,
        rf"WITH {PAIRS}, n AS (SELECT pair_id, trim(regexp_replace(regexp_replace(src, '\p{{C}}', '', 'g'), '\s+', ' ', 'g')) AS src, trim(regexp_replace(regexp_replace(tgt, '\p{{C}}', '', 'g'), '\s+', ' ', 'g')) AS tgt FROM pairs) SELECT * FROM n WHERE length(src) BETWEEN 3 AND 128 AND length(tgt) BETWEEN 3 AND 128",
    ),
    "preprocess_encoded": (
        _two_windows,
        rf"WITH {PAIRS}, n AS (SELECT pair_id, trim(regexp_replace(regexp_replace(src, '\p{{C}}', '', 'g'), '\s+', ' ', 'g')) AS src, trim(regexp_replace(regexp_replace(tgt, '\p{{C}}', '', 'g'), '\s+', ' ', 'g')) AS tgt FROM pairs), t AS (SELECT pair_id, src, tgt, {sql_words('src')} AS src_tokens, {sql_words('tgt')} AS tgt_tokens FROM n) SELECT pair_id, src_tokens, tgt_tokens FROM t WHERE length(src) BETWEEN 3 AND 20 AND length(tgt) BETWEEN 3 AND 20 AND src_tokens BETWEEN 3 AND 20 AND tgt_tokens BETWEEN 3 AND 20",
    ),
    "difficulty_filter": (
        lambda s, d: filtering.difficulty_filter(pairs(s, d).withColumn("similarity_score", F.when(F.col("pair_id") % 2 == 0, 0.5)), 50, 0.7).select("pair_id"),
        f"WITH {PAIRS} SELECT pair_id FROM pairs WHERE length(src) <= 50 AND pair_id % 2 <> 0",
    ),
    "non_zero_reasons": (_reasons, f"WITH {PAIRS}, {CLEANED} SELECT {REASON} AS reject_reason, count(*) AS n FROM cleaned GROUP BY 1 HAVING count(*) > 0"),
    "positional_join": (
        _joined_lines,
        "WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) AS pos, doc_id FROM documents), b AS (SELECT row_number() OVER (ORDER BY page_id) AS pos, page_id FROM pages) SELECT pos, doc_id, page_id FROM a JOIN b USING (pos)",
    ),
    "anti_join_rest": (
        _not_sampled,
        f"WITH {PAIRS} SELECT count(*) AS n, sum(pair_id)::BIGINT AS sum_id FROM pairs WHERE coalesce(NOT (length(tgt) > 0 AND length(src)::DOUBLE / length(tgt) BETWEEN 0.25::DOUBLE AND 0.5::DOUBLE), true)",
    ),
    "lookup_default": (_with_default, "SELECT doc_id, lang, coalesce(quality::DOUBLE, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)"),
    "vocabulary_misses": (
        _misses,
        "WITH k AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark), c AS (SELECT doc_id, unnest(string_split(text, '')) AS char FROM documents) SELECT doc_id, count(*) FILTER (k.char IS NULL) AS misses, count(*) AS n FROM c LEFT JOIN k USING (char) GROUP BY 1",
    ),
    "message_errors": (_responses, "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR coalesce(trim(text), '') = '' THEN 'empty text' END AS error FROM conversations"),
    "embedding_density": (
        _density,
        "WITH x AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT min(x) AS a, max(x) AS b, count(*) AS n FROM x) SELECT least(floor((x - a) / (b - a) * 100), 99)::INT AS bin, count(*) AS n, round(count(*) / any_value(e.n)::DOUBLE, 9) AS share FROM x, e GROUP BY 1",
    ),
    "parameter_counts": (
        _parameters,
        "SELECT sum(p_size)::BIGINT AS total, sum(p_size) FILTER (p_partkey % 3 > 0)::BIGINT AS trainable, sum(p_size) FILTER (p_partkey % 3 = 0)::BIGINT AS frozen, round(sum(p_size) * 4 / 1048576::DOUBLE, 6) AS mb FROM part",
    ),
    "remaining_time": (
        lambda s, d: rounded(analytics.remaining_seconds(table(s, d, "events"), "value", 1_000_000), "mean", "remaining", digits=4),
        "SELECT round(avg(value), 4) AS mean, round(avg(value) * greatest(1000000 - count(*), 0), 4) AS remaining FROM events",
    ),
    "memory_tiers": (
        _tiers,
        "WITH f AS (SELECT p_partkey, p_size * 0.9::DOUBLE AS g FROM part) SELECT p_partkey, CASE WHEN g >= 12 THEN 64 WHEN g >= 8 THEN 32 WHEN g >= 6 THEN 16 ELSE 8 END::BIGINT AS batch, CASE WHEN g >= 12 THEN 16 WHEN g >= 8 THEN 8 WHEN g >= 6 THEN 4 ELSE 2 END::BIGINT AS concurrency FROM f",
    ),
    "last_status": (
        lambda s, d: analytics.last_status(table(s, d, "events").select(F.col("user_id").alias("step"), "event_type", F.struct("ts", "event_id").alias("at")), "step", "event_type", "at"),
        "SELECT user_id AS step, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    ),
    "target_flags": (
        _flags,
        f"WITH {RUNS} SELECT dataset, model, quality * 100 >= 30 AND latency / 40 >= 0.8::DOUBLE AS met, round(exp(-quality), 6) AS confidence FROM runs",
    ),
    "roundtrip_aligned_text": (
        _aligned,
        f"WITH {PAIRS}, t AS (SELECT pair_id, trim(src, ' ') AS src, trim(tgt, ' ') AS tgt FROM pairs), r AS (SELECT *, row_number() OVER (ORDER BY pair_id) AS pos FROM t WHERE src <> '' AND tgt <> '') SELECT count(*) AS n, sum(pos * length(src))::BIGINT AS left, sum(pos * length(tgt))::BIGINT AS right FROM r",
    ),
    "roundtrip_csv_pairs": (_csv_pairs, "SELECT p_type AS tgt, count(*) AS n FROM part GROUP BY 1"),
    "roundtrip_folder": (_folder, "SELECT lang AS src, source AS tgt, count(*) AS n FROM documents GROUP BY ALL"),
}
