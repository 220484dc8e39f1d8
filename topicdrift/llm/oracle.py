"""DuckDB SQL that gives the rows of the queries, where SQL can express them."""

from __future__ import annotations

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13)
), least AS (
  SELECT gram, min(doc_id) AS first FROM w GROUP BY gram
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i
  FROM (SELECT w.doc_id, w.i FROM w JOIN least USING (gram) WHERE least.first < w.doc_id), (SELECT unnest(range(0, 13)) AS k)
), k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) x
  ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

URL_REPUTATION = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM u
), l AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS outcome FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), g AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix,
    count(outcome) AS n, coalesce(sum(outcome), 0) AS bad
  FROM h LEFT JOIN l USING (page_id) GROUP BY host
), d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM g GROUP BY suffix, domain
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix
), o AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS rate FROM s
), levels AS (
  SELECT 'suffix' AS level, n, bad FROM s UNION ALL SELECT 'domain', n, bad FROM d UNION ALL SELECT 'host', n, bad FROM g
), m AS (
  SELECT level, sum(n) AS pages, sum(bad) AS bad, sum(n * n) AS squares, count(*) AS groups, sum(bad) / sum(n) AS mean
  FROM levels WHERE n > 0 GROUP BY level
), k AS (
  SELECT m.level, any_value(pages) AS pages, any_value(m.bad) AS bad, any_value(groups) AS groups,
    (sum(x.n * (x.bad / x.n - mean) * (x.bad / x.n - mean)) - any_value(mean * (1 - mean)) * (any_value(groups) - 1))
    / (any_value(mean * (1 - mean)) * (any_value(pages) - any_value(squares) / any_value(pages) - (any_value(groups) - 1)) + 1e-12) AS related
  FROM m JOIN (SELECT * FROM levels WHERE n > 0) x USING (level) GROUP BY m.level
), strength AS (
  SELECT level, CASE WHEN bad = 0 OR bad = pages OR groups < 2 OR related <= 1 / 10001.0 THEN 10000.0 ELSE greatest(1.0, 1 / related - 1) END AS k FROM k
), ss AS (
  SELECT suffix, (bad + coalesce((SELECT k FROM strength WHERE level = 'suffix'), 10000.0) * (SELECT rate FROM o)) / (n + coalesce((SELECT k FROM strength WHERE level = 'suffix'), 10000.0)) AS rate FROM s
), dd AS (
  SELECT domain, (bad + coalesce((SELECT k FROM strength WHERE level = 'domain'), 10000.0) * rate) / (n + coalesce((SELECT k FROM strength WHERE level = 'domain'), 10000.0)) AS rate FROM d JOIN ss USING (suffix)
), hh AS (
  SELECT host, n, (bad + coalesce((SELECT k FROM strength WHERE level = 'host'), 10000.0) * rate) / (n + coalesce((SELECT k FROM strength WHERE level = 'host'), 10000.0)) AS rate FROM g JOIN dd USING (domain)
), r AS (
  SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (n + coalesce((SELECT k FROM strength WHERE level = 'host'), 10000.0) + 1)) AS lower FROM hh
), judged AS (
  SELECT page_id, h.host, path, lower,
    CASE WHEN (h.host = 'example.net' OR ends_with(h.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (h.host = 'example.com' OR ends_with(h.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (h.host = 'org' OR ends_with(h.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (h.host = 'net' OR ends_with(h.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h JOIN r USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), twice AS (
  SELECT doc_id, gram FROM w GROUP BY doc_id, gram HAVING count(*) > 1
), r AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, i + k AS i FROM (SELECT w.doc_id, w.i FROM w JOIN twice USING (doc_id, gram)), (SELECT unnest(range(0, 5)) AS k)
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, length(regexp_replace(line, '[ \t\n\x0B\f\r]', '', 'g')) AS solid
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')
), c AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(solid) FILTER (
    (regexp_matches(line, '[.!?:;…。！？]["''”’»)\]]*[ \t\x0B\f\r]*$') OR regexp_matches(line, '[.!?] .*[.!?] '))
    AND length(line) - length(translate(line, '|»›•·', '')) < 3
    AND NOT regexp_matches(line, '(?i)cookie|all rights reserved|copyright|©|privacy policy|terms of (use|service)|javascript|lorem ipsum|subscribe|sign up|log ?in|click here|read more|share this|licen[sc]ed under|released under')
    AND (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) / greatest(solid, 1) <= 0.1
    AND (length(line) - length(regexp_replace(line, '\p{Lu}', '', 'g'))) / greatest(solid, 1) <= 0.6), 0) AS solid
  FROM lines GROUP BY doc_id
), b AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(c.solid, 0) AS solid
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND solid >= 0.5 * word_chars AS kept
FROM b"""

# The remainder table of CRC-32 from its polynomial, and a step for each byte of a text. `crc(source, key, text)`
# gives tables ending in `crc (key, crc)`.
def _crc(source: str, key: str, text: str) -> str:
    bits = "list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, byte)"
    return f"""remainders AS MATERIALIZED (
  SELECT list({bits} ORDER BY byte) AS rest FROM (SELECT unnest(range(0, 256)) AS byte)
), coded AS MATERIALIZED (
  SELECT {key}, list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')[:-2],
    lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM {source}
), crc AS MATERIALIZED (
  SELECT {key}, xor(list_reduce(bytes, lambda c, b: xor(c // 256, rest[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS crc
  FROM coded, remainders
)"""


TARGET_RESAMPLING = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), counted AS MATERIALIZED (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM words) GROUP BY ALL
), listed AS (SELECT word FROM counted UNION SELECT word FROM wanted
), """ + _crc("listed", "word", "word") + r""", bucketed AS MATERIALIZED (SELECT word, crc % 10000 AS bucket FROM crc
), raw AS (SELECT bucket, sum(n) AS s FROM counted JOIN bucketed USING (word) GROUP BY bucket
), target AS (SELECT bucket, count(*) AS t FROM wanted JOIN bucketed USING (word) GROUP BY bucket
), gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM raw) + 10000.0::DOUBLE)
    / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM target) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM bucketed) LEFT JOIN raw USING (bucket) LEFT JOIN target USING (bucket)
), weights AS (SELECT doc_id, sum(n * gain) AS weight FROM counted JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM placed) THEN CAST(place AS BIGINT) END AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""

SHARDING = """
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
    CAST('0x' || substr(sha256(coalesce(text, '')), 1, 15) AS BIGINT) AS own FROM documents
), groups AS (SELECT own, CAST(sum(size) AS BIGINT) AS bytes FROM rows GROUP BY own
), marked AS MATERIALIZED (SELECT own, bytes, bytes * 1536 > (SELECT sum(size) FROM rows) AS large FROM groups
), items AS (
  SELECT large, CASE WHEN large THEN own ELSE own % 6144 END AS item, CAST(sum(bytes) AS BIGINT) AS bytes FROM marked GROUP BY ALL
), listed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY bytes DESC, large DESC, item) AS place FROM items
), placed AS (
  SELECT CAST(0 AS BIGINT) AS place, list_transform(range(0, 24), lambda x: CAST(0 AS BIGINT)) AS loads, 0 AS shard
  UNION ALL
  SELECT next.place, list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN bytes ELSE 0 END),
    list_position(loads, list_min(loads)) - 1
  FROM placed JOIN listed AS next ON next.place = placed.place + 1
), found AS MATERIALIZED (
  SELECT large, item, CAST(shard AS INTEGER) AS shard FROM listed JOIN placed USING (place)
), crc_of AS (SELECT DISTINCT own, text FROM rows
), """ + _crc("crc_of", "own", "text") + """
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows JOIN marked USING (own) JOIN crc USING (own)
JOIN found ON found.large = marked.large AND found.item = CASE WHEN marked.large THEN own ELSE own % 6144 END"""
