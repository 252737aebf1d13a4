"""DuckDB SQL of those registered queries that SQL can express."""

LINE_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), lined AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines,
    list_transform(string_split(text, chr(10)), lambda x: translate(
      trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
  FROM docs
), frequent AS (
  SELECT key FROM (SELECT DISTINCT doc_id, unnest(keys) AS key FROM lined)
  WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10
), places AS (
  SELECT doc_id, md5(text) AS text_key, i, lines[i] AS line, keys[i] AS key
  FROM (SELECT doc_id, text, lines, keys, unnest(range(1, len(lines) + 1)) AS i FROM lined)
), kept AS (
  SELECT p.doc_id, p.text_key, count(*) AS n_lines,
    count(f.key) AS n_dropped,
    coalesce(string_agg(CASE WHEN f.key IS NULL THEN p.line END, chr(10) ORDER BY p.i), '') AS kept
  FROM places p LEFT JOIN frequent f USING (key) GROUP BY p.doc_id, p.text_key
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept
"""

SOURCE_MIX = r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || doc_id) AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [1, 2, 3][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
      ORDER BY (3 * source_size) / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
    / (sum(weight) OVER (ORDER BY (3 * source_size) / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM totals
), targets AS (
  SELECT source, source_size,
    least(weight * max(level) OVER (), (3 * source_size)::DOUBLE) AS target
  FROM levels
), budgets AS (
  SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS budget FROM targets
), summed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size
    + least(size, greatest(0, budget - (budget // source_size) * source_size - start))
   ELSE 0 END)::BIGINT AS taken
FROM summed
"""

#: Every order is followed on its own here, document by document.
FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), originals AS (
  SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
), marks AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS failures
  FROM texts JOIN originals USING (text) LEFT JOIN marks USING (doc_id)
), kinds AS (
  SELECT part, failures, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing GROUP BY part, failures
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x)
    AND e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), met AS (
  SELECT k.*, s.filter_order, s.step, s.letter, contains(k.failures, s.letter) AS fails,
    s.earlier = translate(s.earlier, k.failures, '') AS arrives
  FROM kinds k, steps s
), counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (arrives AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (arrives AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND NOT arrives), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failures = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (arrives AND fails), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (arrives AND fails), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails,
  good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""


def _vector_codes(rounds: int = 6) -> str:
    """Lloyd's rounds with every part compared with every entry."""
    parts = r"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 8 AS width FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), components AS (
  SELECT vec_id, (i - 1) // width AS position, (i - 1) % width AS i,
    floor(4096 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), numbered AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept
), book0 AS MATERIALIZED (
  SELECT position, entry, i, x FROM components JOIN numbered USING (vec_id) WHERE entry < 16
)"""
    for number in range(rounds + 1):
        parts += f""", near{number} AS MATERIALIZED (
  SELECT vec_id, position, min({{'error': error, 'entry': entry}}) AS best FROM (
    SELECT c.vec_id, c.position, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS error
    FROM components c JOIN book{number} b USING (position, i) GROUP BY c.vec_id, c.position, b.entry)
  GROUP BY vec_id, position
)"""
        if number < rounds:
            parts += f""", book{number + 1} AS MATERIALIZED (
  SELECT position, entry, i, coalesce(moved.x, book.x) AS x FROM book{number} book LEFT JOIN (
    SELECT c.position, n.best.entry AS entry, c.i,
      ((sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM components c JOIN near{number} n USING (vec_id, position)
    GROUP BY c.position, n.best.entry, c.i) moved USING (position, entry, i)
)"""
    return parts + f""", coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY position) AS code,
    sum(best.error)::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id
), final AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY position, entry, i)) AS codebooks_sha256
  FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), final
"""


ORACLES: dict[str, str] = {
    "op4_source_mix": SOURCE_MIX,
    "op10_line_dedup": LINE_DEDUP,
    "op11_filter_audit": FILTER_AUDIT,
    "op13_vector_codes": _vector_codes(),
}
