"""Queries over pairs of adjacent lines: cleaning, filtering, sampling, splitting, curricula and mixing, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import arrays, scores, text
from textloom.operators import augment, cleaning, curriculum, filtering, sampling, splits
from textloom.sources.adapters import pairs_lines, table

#: DuckDB's view of the pairs, and expressions that the queries share.
PAIRS = r"""pairs AS (
  SELECT d.doc_id * 1000000 + t.i - 1 AS pair_id, d.l[t.i] AS src, d.l[t.i + 1] AS tgt, d.source
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents) d, unnest(range(1, len(d.l))) AS t(i))"""


def sql_space(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def sql_words(c: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"


def sql_shuffle(c: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {c}::VARCHAR)"


def sql_repeat(c: str) -> str:
    """Share of repeated trigrams of words."""
    return rf"""(SELECT CASE WHEN len(w) < 3 THEN 0.0::DOUBLE ELSE 1 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i+1] || chr(1) || w[i+2]))) / (len(w) - 2)::DOUBLE END
      FROM (SELECT list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '') AS w))"""


CLEANED = f"cleaned AS (SELECT pair_id, {sql_space('src')} AS src, {sql_space('tgt')} AS tgt, source FROM pairs)"
REASON = """CASE WHEN trim(src) = '' OR trim(tgt) = '' THEN 'empty'
  WHEN length(src) NOT BETWEEN 5 AND 200 THEN 'zh_length' WHEN length(tgt) NOT BETWEEN 10 AND 500 THEN 'en_length'
  WHEN length(src)::DOUBLE / length(tgt) NOT BETWEEN 0.1::DOUBLE AND 0.8::DOUBLE THEN 'ratio' ELSE 'valid' END"""
VALID = f"{PAIRS}, {CLEANED}, judged AS (SELECT *, {REASON} AS reason FROM cleaned), valid AS (SELECT * FROM judged WHERE reason = 'valid')"
HASH = "md5(trim(src) || '|||' || trim(tgt))"
SIMILARITY = f"CASE WHEN greatest(length(src), {sql_words('tgt')}) > 0 THEN least(length(src), {sql_words('tgt')})::DOUBLE / greatest(length(src), {sql_words('tgt')}) ELSE 0.0::DOUBLE END"
AVERAGE = f"((length(src) + {sql_words('tgt')}) / 2::DOUBLE)"
WORD_RATIO = f"CASE WHEN {sql_words('tgt')} > 0 THEN length(src)::DOUBLE / {sql_words('tgt')} ELSE 1.0::DOUBLE END"
DIFFICULTY = f"CASE WHEN {AVERAGE} < 25 AND {WORD_RATIO} BETWEEN 0.5::DOUBLE AND 2 THEN 'easy' WHEN {AVERAGE} >= 100 OR {WORD_RATIO} < 0.3::DOUBLE OR {WORD_RATIO} > 3 THEN 'hard' ELSE 'medium' END"
LENGTH_GROUP = f"CASE WHEN {AVERAGE} < 30 THEN 'short' WHEN {AVERAGE} < 80 THEN 'medium' ELSE 'long' END"
PASSED = f"""{PAIRS}, passed AS (
  SELECT *, length(src)::DOUBLE / length(tgt) AS length_ratio FROM pairs
  WHERE length(tgt) > 0 AND length(src)::DOUBLE / length(tgt) BETWEEN 0.25::DOUBLE AND 0.5::DOUBLE
    AND NOT {sql_repeat('src')} > 0.3::DOUBLE AND NOT {sql_repeat('tgt')} > 0.3::DOUBLE)"""
FILTERED = f"""{PASSED}, scored AS (SELECT *, {SIMILARITY} AS similarity_score FROM passed),
filtered AS (SELECT *, CASE WHEN {AVERAGE} < 30 AND similarity_score >= 0.85::DOUBLE THEN 'easy' WHEN {AVERAGE} < 80 AND similarity_score >= 0.7::DOUBLE THEN 'medium' ELSE 'hard' END AS difficulty
  FROM scored WHERE similarity_score >= 0.7::DOUBLE)"""
PREFILTERED = f"{PAIRS}, pre AS (SELECT * FROM pairs WHERE length(src) <= 128 AND {sql_words('tgt')} <= 128 AND length(trim(src, ' ')) >= 3 AND length(trim(tgt, ' ')) >= 3)"
META = f"{PREFILTERED}, meta AS (SELECT pair_id, src, tgt, source, {SIMILARITY} AS similarity_score, {DIFFICULTY} AS difficulty, {LENGTH_GROUP} AS length_group FROM pre), good AS (SELECT * FROM meta WHERE similarity_score >= 0.75::DOUBLE)"


def stratified_sql(target: int) -> str:
    return f"""WITH {META}, strata AS (SELECT count(*) AS n FROM (SELECT DISTINCT difficulty, length_group FROM good)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY difficulty, length_group ORDER BY similarity_score DESC, pair_id) AS rn FROM good),
late AS (SELECT r.*, rn > greatest({target} // greatest(n, 1), 1) AS late FROM ranked r, strata)
SELECT pair_id, difficulty, length_group, similarity_score FROM late ORDER BY late, similarity_score DESC, pair_id LIMIT {target}"""


STAGED = f"staged AS (SELECT pair_id, src, tgt, {DIFFICULTY} AS stage FROM pairs)"
#: Synthetic pairs: the reverse of each pair, with a confidence made from its id.
SYNTHETIC = f"synthetic AS (SELECT pair_id, tgt AS src, src AS tgt, source, (('0x' || substr({sql_shuffle('pair_id', 7)}, 1, 6))::BIGINT % 1000) / 1000::DOUBLE AS confidence FROM pairs)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_lines(table(spark, sf_dir, "documents"))


def synthetic(rows: DataFrame) -> DataFrame:
    confidence = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("7"), F.col("pair_id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long") % 1000 / F.lit(1000.0)
    return rows.select("pair_id", F.col("tgt").alias("src"), F.col("src").alias("tgt"), "source", confidence.alias("confidence"))


def _cascade(s, d):
    return cleaning.reason_counts(cleaning.validated(cleaning.normalized(pairs(s, d))))


def _cleaned(s, d):
    return cleaning.clean(pairs(s, d))


def _retention(s, d):
    return cleaning.cleaning_stats(pairs(s, d))


def _passed(s, d):
    return filtering.repeat_filter(filtering.ratio_filter(pairs(s, d)))


def _filtered(s, d):
    return filtering.filter_pipeline(pairs(s, d))


def _good(s, d):
    return sampling.with_metadata(sampling.prefiltered(pairs(s, d))).filter("similarity_score >= 0.75D")


def _difficulty_score(s, d):
    score = scores.difficulty_score(F.length("src"), scores.fallback_similarity(F.col("src"), F.col("tgt")), F.lit(0.0))
    rows = pairs(s, d).select(scores.difficulty_level(score).alias("level"), score.alias("score"))
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


def _oov(s, d):
    known = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [" "]
    return table(s, d, "benchmark").select("item_id", F.round(arrays.oov_ratio(F.col("text"), known), 9).alias("oov_ratio"))


def _split(s, d):
    return splits.train_val_test(pairs(s, d).select("pair_id"), "pair_id")


def _bucketed(s, d):
    return pairs(s, d).select("pair_id", splits.length_bucket(F.length("src")).alias("bucket"))


def _batches(s, d):
    rows = splits.bucket_batches(_bucketed(s, d), "bucket", "pair_id", 32, drop_last=True)
    return rows.groupBy("bucket", "batch_id").agg(F.count("*").alias("n"), F.min("pair_id").alias("first_id"), F.sum("pair_id").cast("long").alias("sum_id"))


def _staged(s, d):
    return curriculum.stage_of(pairs(s, d))


def _epochs(s, d):
    return s.range(10).select(F.col("id").alias("epoch"), curriculum.stage_of_epoch(F.col("id"), 10).alias("stage"))


def _active(s, d):
    return curriculum.active_counts(_staged(s, d), 10)


def _epoch_order(s, d):
    return curriculum.active_rows(_staged(s, d), 1, 10, "pair_id").select("pair_id", "position")


def _dynamic(s, d):
    rows = _staged(s, d).withColumn("loss", F.length("src") / F.lit(100.0))
    out = curriculum.dynamic_curriculum(rows, "stage", "loss", 1000, 1.0)
    return out.select("stage", "n", F.round("avg_loss", 6).alias("avg_loss"), F.round("weight", 6).alias("weight"), F.col("take").cast("long").alias("take"))


def _mixed(s, d):
    rows = pairs(s, d)
    return augment.mix_synthetic(rows, synthetic(rows), 0.5).select("pair_id", "is_synthetic")


def _mix_stats(s, d):
    return augment.mix_stats(_mixed(s, d)).withColumn("ratio", F.round("ratio", 9))


def _iterative(s, d):
    rows = pairs(s, d)
    out = augment.iterative_union(rows.select("pair_id", "src"), rows.select("pair_id", F.col("tgt").alias("src")), 3, 300)
    return out.groupBy("iteration").agg(F.count("*").alias("n"), F.sum("pair_id").cast("long").alias("sum_id"))


def _synthetic_kept(s, d):
    return filtering.synthetic_filter(synthetic(pairs(s, d))).select("pair_id", "confidence")


def _augmented(s, d):
    """Words dropped by hash; rows whose words changed."""
    rows = pairs(s, d).select("pair_id", F.filter(F.split("src", " "), lambda w: w != "").alias("w"))
    kept = augment.drop_words(F.col("w"), F.col("pair_id"), 0.1)
    return rows.select("pair_id", F.array_join(kept, " ").alias("text"))


def _summary(s, d):
    x = F.col("similarity_score")
    rows = _passed(s, d).withColumn("similarity_score", scores.fallback_similarity(F.col("src"), F.col("tgt")))
    return rows.agg(*[F.round(f, 6).alias(n) for n, f in (("mean", F.avg(x)), ("median", F.percentile(x, 0.5)), ("std", F.stddev_pop(x)), ("low", F.min(x)), ("high", F.max(x)))])


_DROP = r"""WITH pairs_w AS (SELECT pair_id, list_filter(string_split(src, ' '), lambda x: x <> '') AS w FROM pairs),
kept AS (SELECT pair_id, w, list_filter(w, lambda x, i: (('0x' || substr(md5(pair_id::VARCHAR || ':' || (i - 1)::VARCHAR), 1, 8))::BIGINT / 4294967296::DOUBLE) >= 0.1::DOUBLE) AS k FROM pairs_w)
SELECT pair_id, array_to_string(CASE WHEN len(w) < 3 THEN w WHEN len(k) > 0 THEN k ELSE w[1:1] END, ' ') AS text FROM kept"""
_TAGS = ("'<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#39;', chr(39))")

QUERIES = {
    "clean_cascade_counts": (_cascade, f"WITH {VALID} SELECT reason AS reject_reason, count(*) AS n FROM judged GROUP BY 1"),
    "clean_dedup_pairs": (
        _cleaned,
        f"WITH {VALID} SELECT pair_id, src, tgt, source FROM (SELECT *, row_number() OVER (PARTITION BY {HASH} ORDER BY pair_id) AS rn FROM valid) WHERE rn = 1",
    ),
    "clean_retention": (
        _retention,
        f"""WITH {VALID}, c AS (SELECT count(*) AS total, count(*) FILTER (reason IN ('zh_length', 'en_length')) AS length_filtered, count(*) FILTER (reason = 'ratio') AS ratio_filtered,
count(*) FILTER (reason IN ('zh_lang', 'en_lang')) AS language_filtered, count(*) FILTER (reason = 'empty') AS empty_filtered, count(*) FILTER (reason = 'valid') AS v, count(DISTINCT CASE WHEN reason = 'valid' THEN {HASH} END) AS final FROM judged),
h AS (SELECT count(*) FILTER (regexp_matches(src, '<[^>]+>') OR regexp_matches(tgt, '<[^>]+>')) AS html_cleaned FROM pairs)
SELECT total, length_filtered, ratio_filtered, language_filtered, empty_filtered, v - final AS duplicates, html_cleaned, final, final * 100.0::DOUBLE / total AS retention_rate FROM c, h""",
    ),
    "strip_html_pages": (
        lambda s, d: table(s, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("text")),
        f"SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, {_TAGS} AS text FROM pages",
    ),
    "redact_email_docs": (
        lambda s, d: table(s, d, "documents").select("doc_id", text.strip_emails(F.col("text")).alias("text")),
        r"SELECT doc_id, regexp_replace(text, '[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+', '', 'g') AS text FROM documents",
    ),
    "collapse_whitespace": (
        lambda s, d: table(s, d, "documents").select("doc_id", text.collapse_space(F.col("text")).alias("text")),
        f"SELECT doc_id, {sql_space('text')} AS text FROM documents",
    ),
    "char_word_counts": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), text.word_count(F.col("text")).cast("long").alias("words"), text.cjk_count(F.col("text")).cast("long").alias("han")),
        f"SELECT doc_id, length(text) AS chars, {sql_words('text')} AS words, len(regexp_extract_all(text, '[㐀-䶿一-鿿]')) AS han FROM documents",
    ),
    "ngram_repeat_docs": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.round(arrays.repeat_ratio(text.tokens(F.col("text"))), 9).alias("repeat_ratio")),
        f"SELECT doc_id, round({sql_repeat('text')}, 9) AS repeat_ratio FROM documents",
    ),
    "length_ratio_filter": (
        lambda s, d: filtering.ratio_filter(pairs(s, d)).select("pair_id", "length_ratio"),
        f"WITH {PAIRS} SELECT pair_id, length(src)::DOUBLE / length(tgt) AS length_ratio FROM pairs WHERE length(tgt) > 0 AND length(src)::DOUBLE / length(tgt) BETWEEN 0.25::DOUBLE AND 0.5::DOUBLE",
    ),
    "ngram_filter": (lambda s, d: filtering.repeat_filter(pairs(s, d)).select("pair_id"), f"WITH {PAIRS} SELECT pair_id FROM pairs WHERE NOT {sql_repeat('src')} > 0.3::DOUBLE AND NOT {sql_repeat('tgt')} > 0.3::DOUBLE"),
    "fallback_similarity": (
        lambda s, d: pairs(s, d).select("pair_id", scores.fallback_similarity(F.col("src"), F.col("tgt")).alias("similarity")),
        f"WITH {PAIRS} SELECT pair_id, {SIMILARITY} AS similarity FROM pairs",
    ),
    "filter_pipeline": (
        lambda s, d: _filtered(s, d).select("pair_id", "length_ratio", "similarity_score", "difficulty"),
        f"WITH {FILTERED} SELECT pair_id, length_ratio, similarity_score, difficulty FROM filtered",
    ),
    "filter_head": (
        lambda s, d: filtering.ordered_head(_filtered(s, d), 100).select("pair_id", "difficulty"),
        f"WITH {FILTERED} SELECT pair_id, difficulty FROM filtered ORDER BY pair_id LIMIT 100",
    ),
    "difficulty_filter_dist": (lambda s, d: sampling.distribution(_filtered(s, d), "difficulty"), f"WITH {FILTERED} SELECT difficulty AS value, count(*) AS n FROM filtered GROUP BY 1"),
    "similarity_summary": (
        _summary,
        f"WITH {PASSED}, x AS (SELECT {SIMILARITY} AS s FROM passed) SELECT round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(stddev_pop(s), 6) AS std, round(min(s), 6) AS low, round(max(s), 6) AS high FROM x",
    ),
    "length_group_dist": (
        lambda s, d: sampling.distribution(sampling.with_metadata(sampling.prefiltered(pairs(s, d))), "length_group"),
        f"WITH {META} SELECT length_group AS value, count(*) AS n FROM meta GROUP BY 1",
    ),
    "sampler_difficulty_dist": (
        lambda s, d: sampling.distribution(sampling.with_metadata(sampling.prefiltered(pairs(s, d))), "difficulty"),
        f"WITH {META} SELECT difficulty AS value, count(*) AS n FROM meta GROUP BY 1",
    ),
    "sample_ids": (
        lambda s, d: sampling.sample_ids(sampling.prefiltered(pairs(s, d))).select("pair_id", "id"),
        f"WITH {PREFILTERED} SELECT pair_id, printf('sample_%08d', row_number() OVER (ORDER BY pair_id) - 1) AS id FROM pre",
    ),
    "difficulty_score": (
        _difficulty_score,
        f"WITH {PAIRS}, x AS (SELECT 0.4::DOUBLE * least(length(src) / 100::DOUBLE, 1.0::DOUBLE) + 0.4::DOUBLE * (1 - ({SIMILARITY})) + 0.2::DOUBLE * 0 AS score FROM pairs) SELECT CASE WHEN score < 0.3::DOUBLE THEN 'easy' WHEN score < 0.6::DOUBLE THEN 'medium' ELSE 'hard' END AS level, count(*) AS n, round(avg(score), 6) AS avg_score FROM x GROUP BY 1",
    ),
    "oov_ratio": (_oov, "SELECT item_id, round(length(regexp_replace(text, '[a-z ]', '', 'g'))::DOUBLE / length(text), 9) AS oov_ratio FROM benchmark"),
    "stratified_topk": (
        lambda s, d: sampling.stratified(_good(s, d), 100).select("pair_id", "difficulty", "length_group", "similarity_score"),
        stratified_sql(100),
    ),
    "diversity_cap": (
        lambda s, d: sampling.bucket_capped(_good(s, d)).select("pair_id", "bucket"),
        f"""WITH {META}, b AS (SELECT pair_id, floor(similarity_score / 0.05::DOUBLE)::INT AS bucket FROM good), size AS (SELECT greatest(count(*) // greatest(count(DISTINCT bucket), 1), 1) AS cap FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {sql_shuffle('pair_id')}, pair_id) AS rn FROM b) SELECT pair_id, bucket FROM r, size WHERE rn <= cap""",
    ),
    "hq_sample_end_to_end": (
        lambda s, d: sampling.high_quality_sample(pairs(s, d), sampling.SamplerRules(target=300)).select("pair_id", "difficulty", "length_group", "similarity_score"),
        stratified_sql(300),
    ),
    "split_sizes": (
        lambda s, d: _split(s, d).groupBy("split").agg(F.count("*").alias("n")),
        f"""WITH {PAIRS}, n AS (SELECT count(*) AS n, floor(count(*) * 0.9::DOUBLE)::BIGINT AS a, floor(count(*) * 0.05::DOUBLE)::BIGINT AS b FROM pairs)
SELECT split, n FROM (SELECT 'train' AS split, a AS n FROM n UNION ALL SELECT 'val', b FROM n UNION ALL SELECT 'test', n - a - b FROM n) WHERE n > 0""",
    ),
    "split_assignment": (
        _split,
        f"""WITH {PAIRS}, n AS (SELECT floor(count(*) * 0.9::DOUBLE) AS a, floor(count(*) * 0.05::DOUBLE) AS b FROM pairs),
r AS (SELECT pair_id, row_number() OVER (ORDER BY {sql_shuffle('pair_id')}, pair_id) AS rn FROM pairs)
SELECT pair_id, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'val' ELSE 'test' END AS split FROM r, n""",
    ),
    "length_buckets": (
        lambda s, d: _bucketed(s, d).groupBy("bucket").agg(F.count("*").alias("n")),
        f"WITH {PAIRS}, x AS (SELECT length(src) AS n FROM pairs) SELECT CASE WHEN n <= 32 THEN 0 WHEN n <= 64 THEN 1 WHEN n <= 128 THEN 2 WHEN n <= 256 THEN 3 WHEN n <= 512 THEN 4 ELSE 5 END AS bucket, count(*) AS n FROM x GROUP BY 1",
    ),
    "bucket_batches": (
        _batches,
        f"""WITH {PAIRS}, x AS (SELECT pair_id, length(src) AS n FROM pairs), b AS (SELECT pair_id, CASE WHEN n <= 32 THEN 0 WHEN n <= 64 THEN 1 WHEN n <= 128 THEN 2 WHEN n <= 256 THEN 3 WHEN n <= 512 THEN 4 ELSE 5 END AS bucket FROM x),
r AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY {sql_shuffle('pair_id')}, pair_id) - 1) // 32 AS batch_id FROM b)
SELECT bucket, batch_id, count(*) AS n, min(pair_id) AS first_id, sum(pair_id)::BIGINT AS sum_id FROM r GROUP BY ALL HAVING count(*) = 32""",
    ),
    "dataset_stats": (
        lambda s, d: splits.dataset_stats(pairs(s, d)).select("n", F.round("avg_src", 6).alias("avg_src"), F.round("avg_tgt", 6).alias("avg_tgt"), F.col("max_src").cast("long").alias("max_src"), F.col("max_tgt").cast("long").alias("max_tgt"), F.round("avg_tgt_words", 6).alias("avg_tgt_words")),
        f"WITH {PAIRS} SELECT count(*) AS n, round(avg(length(src)), 6) AS avg_src, round(avg(length(tgt)), 6) AS avg_tgt, max(length(src)) AS max_src, max(length(tgt)) AS max_tgt, round(avg({sql_words('tgt')}), 6) AS avg_tgt_words FROM pairs",
    ),
    "curriculum_stage_by_epoch": (_epochs, "SELECT range AS epoch, CASE WHEN range / 10::DOUBLE < 0.3::DOUBLE THEN 'easy' WHEN range / 10::DOUBLE < 0.7::DOUBLE THEN 'medium' ELSE 'hard' END AS stage FROM range(10)"),
    "curriculum_active_counts": (
        _active,
        f"""WITH {PAIRS}, {STAGED}, c AS (SELECT count(*) FILTER (stage = 'easy') AS e, count(*) FILTER (stage <> 'hard') AS m, count(*) AS h FROM staged),
ep AS (SELECT range AS epoch, CASE WHEN range / 10::DOUBLE < 0.3::DOUBLE THEN 'easy' WHEN range / 10::DOUBLE < 0.7::DOUBLE THEN 'medium' ELSE 'hard' END AS stage FROM range(10))
SELECT epoch, stage, CASE WHEN stage = 'easy' AND e > 0 THEN e WHEN stage <> 'hard' AND m > 0 THEN m ELSE h END AS n FROM ep, c""",
    ),
    "curriculum_epoch_order": (
        _epoch_order,
        f"WITH {PAIRS}, {STAGED} SELECT pair_id, row_number() OVER (ORDER BY {sql_shuffle('pair_id', 43)}, pair_id) AS position FROM staged WHERE stage = 'easy'",
    ),
    "curriculum_sampling": (
        lambda s, d: curriculum.curriculum_sets(pairs(s, d)),
        f"""WITH {PAIRS}, x AS (SELECT CASE WHEN length(src) <= 100 THEN 1 ELSE 2 END AS r, count(*) AS n FROM pairs GROUP BY 1)
SELECT CASE r WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS stage, (sum(n) OVER (ORDER BY r))::BIGINT AS n FROM x""",
    ),
    "dynamic_weights": (
        _dynamic,
        f"""WITH {PAIRS}, {STAGED}, a AS (SELECT stage, count(*) AS n, avg(length(src) / 100::DOUBLE) AS l FROM staged GROUP BY 1),
v AS (SELECT *, CASE WHEN l = 0 THEN 1 ELSE l END AS v FROM a), e AS (SELECT *, exp(v - max(v) OVER ()) AS e FROM v), w AS (SELECT *, e / sum(e) OVER () AS w FROM e)
SELECT stage, n, round(l, 6) AS avg_loss, round(w, 6) AS weight, least(floor(w * 1000)::BIGINT, n) AS take FROM w""",
    ),
    "mix_synthetic": (
        _mixed,
        f"""WITH {PAIRS}, r AS (SELECT count(*) AS n FROM pairs), o AS (SELECT pair_id, row_number() OVER (ORDER BY {sql_shuffle('pair_id')}, pair_id) AS rn FROM pairs)
SELECT pair_id, false AS is_synthetic FROM pairs UNION ALL SELECT pair_id, true FROM o, r WHERE rn <= floor(n * 0.5::DOUBLE)""",
    ),
    "mix_stats": (
        _mix_stats,
        f"""WITH {PAIRS}, c AS (SELECT count(*) AS real, count(*) AS other FROM pairs), m AS (SELECT real, least(floor(real * 0.5::DOUBLE)::BIGINT, other) AS synthetic FROM c)
SELECT real + synthetic AS total, real, synthetic, round(synthetic::DOUBLE / greatest(real, 1), 9) AS ratio FROM m""",
    ),
    "iterative_union": (
        _iterative,
        f"""WITH {PAIRS}, f AS (SELECT pair_id FROM pairs ORDER BY pair_id LIMIT 100)
SELECT 0 AS iteration, count(*) AS n, sum(pair_id)::BIGINT AS sum_id FROM pairs UNION ALL SELECT i::INT, count(*), sum(pair_id)::BIGINT FROM f, range(1, 4) t(i) GROUP BY i""",
    ),
    "synthetic_filter": (
        _synthetic_kept,
        f"WITH {PAIRS}, {SYNTHETIC} SELECT pair_id, confidence FROM synthetic WHERE confidence >= 0.7::DOUBLE AND length(src)::DOUBLE / greatest(length(tgt), 1) BETWEEN 1 / 3::DOUBLE AND 3",
    ),
    "augment_drop_words": (_augmented, _DROP.replace("WITH pairs_w", f"WITH {PAIRS}, pairs_w")),
    "pair_hashes": (lambda s, d: pairs(s, d).select("pair_id", text.pair_hash(F.col("src"), F.col("tgt")).alias("h")), f"WITH {PAIRS} SELECT pair_id, {HASH} AS h FROM pairs"),
}
