"""The queries of this folder that SQL can express, in DuckDB's SQL; ids are taken to be unique."""

from __future__ import annotations

from textloom.llm.mixing import MIX_SQL

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, t.i, array_to_string(w[t.i:t.i + 19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) t(i)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, range(0, 20) r(k)),
each AS (SELECT doc_id, t.p, w[t.p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

# A digest's 160 bits, from its hexadecimal digits, are read five at a time.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS bits FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(1, 6), lambda j: bits[5 * k + j]::INT * (32 >> j)))::INT]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""

NORMALISED = r"regexp_replace(trim(regexp_replace(lower({line}), '[\s\x0b]+', ' ', 'g')), '[1-9]', '0', 'g')"

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, t.i, array_to_string(w[t.i:t.i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) t(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY 1),
line AS (SELECT doc_id, source, text, {NORMALISED.format(line="x")} AS l, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT *, unnest(lines) AS x FROM d)),
spread AS (SELECT source, l, count(DISTINCT text) AS n FROM line GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY 1),
common AS (SELECT s.source, s.l FROM spread s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source WHERE s.n > 3 AND s.n > 0.02::DOUBLE * h.n),
removed AS (SELECT doc_id, sum(n)::BIGINT AS n FROM line JOIN common c ON line.source IS NOT DISTINCT FROM c.source AND line.l = c.l GROUP BY 1),
counts AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(m.n, 0) AS n_common_words
  FROM d LEFT JOIN repeated r USING (doc_id) LEFT JOIN removed m USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - n_common_words AS rest FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_common_words > 0 AND (rest < 10 OR rest < 0.3::DOUBLE * n_words)) AS kept, n_common_words FROM judged
"""

# CRC-32 takes eight steps for each byte; the byte is mixed in at the first of them.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384)), 4294967295)"""

# A stretch of words i for which the eight words from i on are found again q words later has period q; it's a run with
# smallest period q where no stretch of a smaller one covers it. No run has fewer than 24 words.
PERIODIC = rf"""
WITH h AS (SELECT doc_id, {WORDS} AS w, {CRC32} AS h FROM documents),
planted AS (SELECT doc_id, w, h, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM h),
e AS (SELECT doc_id, CASE WHEN h % 10 = 0 THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // parts) END]) ELSE w END AS w FROM planted),
grams AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 8], ' ') AS g FROM e, unnest(range(0, len(w) - 7)) t(i)),
met AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
stretch AS (
  SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 8 + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM met)
  GROUP BY doc_id, q, k HAVING max(i) - min(i) + 8 + q >= greatest(24, 3 * q)),
run AS (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.n >= x.s + x.n)),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, s, q) = 1),
every AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY 1),
each AS (SELECT doc_id, t.i, w[t.i + 1] AS word FROM e, unnest(range(0, len(w))) t(i)),
gone AS (SELECT DISTINCT doc_id, t.i FROM run, unnest(range(s + q, s + n)) t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, n AS length, q AS period, 1000 * n // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM e LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_P = "(1 + 1000000000::HUGEINT * ({n} + 2) // ({total} + 2 * v))"

DIVERGENCE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT row_number() OVER () AS doc_id, lang, source, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents)),
kept AS (SELECT lang, term FROM d GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM d JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, sum(coalesce(total, 0)) OVER (PARTITION BY g.lang) AS every
  FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY 1) USING (lang)),
each AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, {_P.format(n="coalesce(n, 0)", total="total")} AS p, {_P.format(n="sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, term)", total="every")} AS q
  FROM groups g JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM each x JOIN each y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
part AS (
  SELECT lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM groups g JOIN groups h USING (lang) LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source WHERE g.source <> h.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM each WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM part) WHERE part = 'pair' OR rank <= 10
"""

# All pairs that share a shingle; the groups of links grow by the least id of a neighbour until nothing changes.
CHOSEN_PATH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w),
kinds AS (SELECT s, len(s) AS n, min(doc_id) AS k FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT k, n, unnest(s) AS g FROM kinds),
rare AS (SELECT k, n, g FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f, g) AS i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM grams)) WHERE i <= n - (4 * n + 4) // 5 + 1),
near AS (SELECT DISTINCT x.k AS a, y.k AS b FROM rare x JOIN rare y ON x.g = y.g AND x.k < y.k AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
links AS (SELECT a, b FROM near JOIN kinds x ON x.k = a JOIN kinds y ON y.k = b WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)),
paired AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM paired UNION SELECT r.a, l.b FROM reach r JOIN paired l ON r.b = l.a),
least AS (SELECT a AS k, least(a, min(b)) AS c FROM reach GROUP BY a),
classes AS (SELECT s, coalesce(c, k) AS c FROM kinds LEFT JOIN least USING (k))
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sets LEFT JOIN classes ON sets.s = classes.s
"""

ORACLES = {
    "op1_substring_dedup": SUBSTRING,
    "op3_source_mixing": MIX_SQL.format(documents="documents"),
    "op8_arc_to_warc": WARC,
    "op10_quality_rules": QUALITY,
    "op11_periodic_runs": PERIODIC,
    "op12_source_divergence": DIVERGENCE,
    "op13_chosen_path_dedup": CHOSEN_PATH,
}
