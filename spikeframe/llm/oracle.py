"""DuckDB statements for the queries that SQL can express, written from the definitions."""

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

STATEMENTS = {
    "op1_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS position FROM split),
keyed AS (SELECT *, translate(trim(line, {SPACES}), {LOWER}) AS key FROM line),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, position, line, key IN (SELECT key FROM frequent) AS dropped FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op4_mixing": f"""
WITH doc AS (SELECT doc_id, text, source, len({WORDS}) AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM doc GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::BIGINT AS weight FROM per_source),
before AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(source_size) OVER earlier, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS left_weight
  FROM weighted WINDOW earlier AS (
    ORDER BY source_size::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, (3 * total - 4 * capped) * weight > 4 * left_weight * source_size AS above FROM before),
rest AS (
  SELECT 3 * sum(source_size) - 4 * coalesce(sum(source_size) FILTER (above), 0) AS share,
         sum(weight) FILTER (NOT above) AS weights FROM marked),
target AS (
  SELECT source, source_size,
         CASE WHEN above THEN (2 * source_size)::DOUBLE ELSE (share * weight)::DOUBLE / (2 * weights)::DOUBLE END AS target
  FROM marked, rest),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 't' || text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM doc JOIN target ON doc.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated""",
    "op7_quality_rules": f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM line WHERE trim(line, {SPACES}) <> '' GROUP BY doc_id),
place AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS place FROM doc WHERE len(words) >= 3),
shingle AS (SELECT doc_id, place, words[place] || ' ' || words[place + 1] || ' ' || words[place + 2] AS shingle FROM place),
repeated AS (
  SELECT doc_id, place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, shingle) AS n FROM shingle) WHERE n >= 2),
covered AS (
  SELECT doc_id, count(DISTINCT covered) AS n_repeat_words
  FROM (SELECT doc_id, unnest([place, place + 1, place + 2]) AS covered FROM repeated) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM doc LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 16 * n_words
               OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM judged""",
    "op10_warc": """
WITH page AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
marked AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM page)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM marked""",
    "op11_collocations": f"""
WITH piece AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), {LOWER}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM piece),
total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang),
place AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
gram AS (SELECT lang, words[i:i + k - 1] AS phrase FROM place, range(1, 6) AS size(k) WHERE i + k - 1 <= len(words)),
counts AS (SELECT lang, phrase, len(phrase) AS k, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= 100),
inside AS (
  SELECT c.lang, c.phrase[f:f + m - 1] AS phrase, max(c.a) AS longer
  FROM counts c, range(1, 6) AS first(f), range(2, 5) AS size(m) WHERE m < c.k AND f + m - 1 <= c.k GROUP BY ALL),
open AS (
  SELECT c.* FROM counts c LEFT JOIN inside i USING (lang, phrase) WHERE c.k > 1 AND (i.longer IS NULL OR 100 * i.longer < 100 * c.a)),
cut AS (
  SELECT o.lang, o.phrase, o.a, cut_at, l.a AS l, r.a AS r, n, ((1000::HUGEINT * o.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM open o, range(1, 5) AS cuts(cut_at)
  JOIN counts l ON l.lang = o.lang AND l.phrase = o.phrase[:cut_at]
  JOIN counts r ON r.lang = o.lang AND r.phrase = o.phrase[cut_at + 1:]
  JOIN total t ON t.lang = o.lang WHERE cut_at < o.k),
lowest AS (
  SELECT *, array_to_string(phrase, ' ') AS joined, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) AS place FROM cut),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(joined)) AS rank, joined AS phrase, a, l, r, n, score
  FROM lowest WHERE place = 1)
SELECT * FROM ranked WHERE rank <= 2000""",
    "op13_exact_dedup": r"""
WITH doc AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM doc WINDOW same AS (PARTITION BY text)""",
}
