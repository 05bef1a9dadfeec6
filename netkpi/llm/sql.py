"""DuckDB SQL of the registered queries, written apart from the operators."""

from __future__ import annotations

_TRIMMED = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def line_dedup(table: str) -> str:
    """All columns of ``table`` with ``n_lines``, ``n_dropped`` and ``kept``."""
    key = _LOWER.format(f"trim(line, {_TRIMMED})")
    return f"""numbered AS (SELECT *, row_number() OVER () AS rn FROM {table}),
lines AS (
  SELECT rn, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM numbered)),
keyed AS (SELECT rn, doc_id, pos, line, {key} AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 AND doc_id IS NOT NULL
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, coalesce(doc_id <> keeper, FALSE) AS gone FROM keyed LEFT JOIN shared USING (k)),
built AS (
  SELECT rn, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY rn),
deduped AS (SELECT numbered.*, n_lines, n_dropped, kept FROM numbered JOIN built USING (rn))"""


LINE_DEDUP = f"""WITH {line_dedup("documents")}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"""


def mixing(table: str) -> str:
    """All columns of ``table`` with ``size``, ``source_size``, ``target`` and ``copies``."""
    return f"""sized AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13)
      AS BIGINT) AS h
  FROM {table}),
sources AS (
  SELECT source AS of, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(sum(size * (size * 1000 // (size + 256))) AS BIGINT) / nullif(CAST(sum(size) AS BIGINT), 0) AS middle, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][nth % 3 + 1] AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT of, source_size, middle, least(cap, w * coalesce(
    (SELECT level FROM levels WHERE level <= cap / w ORDER BY cap / w, nth LIMIT 1), 0)) AS target FROM levels),
plan AS (
  SELECT *, least(floor(coalesce(target / nullif(source_size, 0), 0)), 3) AS whole,
    coalesce(target / nullif(source_size, 0), 0) - whole AS part, target - whole * source_size AS rest FROM targets),
units AS (
  SELECT of, rest, h, ((h + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS u,
    greatest(least(part + least(part, 1 - part) * ((size * 1000 // (size + 256) - middle) / 1000::DOUBLE),
      1 - 1 / 1099511627776::DOUBLE), 1 / 1099511627776::DOUBLE) AS p,
    (u / (1 - u)) / (p / (1 - p)) AS q, sum(size) AS words
  FROM sized JOIN plan ON source IS NOT DISTINCT FROM of WHERE part > 0 GROUP BY ALL),
running AS (SELECT *, sum(words) OVER (PARTITION BY of ORDER BY q, h ROWS UNBOUNDED PRECEDING) AS upto FROM units),
crossing AS (
  SELECT of AS cut_of, min((q, h)) AS first_out FROM running WHERE upto > rest GROUP BY of),
sample AS (
  SELECT running.*, first_out IS NULL OR (q, h) < first_out AS inside
  FROM running LEFT JOIN crossing ON of IS NOT DISTINCT FROM cut_of),
gaps AS (SELECT of AS gap_of, max(rest) - coalesce(sum(words) FILTER (inside), 0) AS gap FROM sample GROUP BY of),
closing AS (
  SELECT of AS one_of, min((abs(words - gap), q, h)) AS best
  FROM sample JOIN gaps ON of IS NOT DISTINCT FROM gap_of WHERE NOT inside AND abs(words - gap) < gap GROUP BY of),
chosen AS (
  SELECT sample.of AS chosen_of, sample.h AS chosen_h FROM sample LEFT JOIN closing ON of IS NOT DISTINCT FROM one_of
  WHERE inside OR coalesce((0::DOUBLE, q, h) = (0::DOUBLE, best[2], best[3]), FALSE)),
mixed AS (
  SELECT sized.* EXCLUDE (h), source_size, target, CAST(whole + (chosen_h IS NOT NULL)::INT AS BIGINT) AS copies
  FROM sized JOIN plan ON source IS NOT DISTINCT FROM of
  LEFT JOIN chosen ON source IS NOT DISTINCT FROM chosen_of AND h = chosen_h)"""


MIXING = f"""WITH {mixing("documents")}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"""


TOP_K = """WITH numbers AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
asked AS (SELECT vec_id AS query_id, generate_subscripts(v, 1) AS i, unnest(v) AS a FROM numbers WHERE vec_id % 50 = 0),
known AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS b FROM numbers),
pairs AS (
  SELECT query_id, vec_id, CAST(sum(a * b) AS BIGINT) AS score
  FROM asked JOIN known USING (i) WHERE vec_id <> query_id GROUP BY query_id, vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5"""

_BASE32 = "translate(to_base(CAST('0x' || substr(h, {}, 10) AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
WARC = f"""WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM payloads)
SELECT page_id, strlen(html) AS payload_bytes,
  {" || ".join(_BASE32.format(i) for i in (1, 11, 21, 31))} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM kept"""


FILL_IN_MIDDLE = """WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS ts
  FROM documents),
drawn AS (
  SELECT *, CAST(len(ts) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(ts) + 1) AS i,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(ts) + 1) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM tokens),
cut AS (
  SELECT *, coalesce(array_to_string(ts[1:least(i, j)], ''), '') AS prefix,
    coalesce(array_to_string(ts[least(i, j) + 1:greatest(i, j)], ''), '') AS middle,
    coalesce(array_to_string(ts[greatest(i, j) + 1:], ''), '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut"""


HARD_NEGATIVES = """WITH numbers AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
known AS (SELECT *, row_number() OVER () AS rn FROM numbers),
asked AS (SELECT rn AS anchor, vec_id AS anchor_id, label AS anchor_label, v AS q FROM known WHERE vec_id % 100 = 0),
products AS (
  SELECT anchor, rn, CAST(sum(a * b) AS BIGINT) AS score
  FROM (SELECT anchor, generate_subscripts(q, 1) AS i, unnest(q) AS a FROM asked)
  JOIN (SELECT rn, generate_subscripts(v, 1) AS i, unnest(v) AS b FROM known) USING (i) GROUP BY anchor, rn),
scored AS (
  SELECT anchor, anchor_id, anchor_label, rn, vec_id, label, score
  FROM products JOIN asked USING (anchor) JOIN known USING (rn) WHERE vec_id <> anchor_id),
positives AS (
  SELECT anchor, anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS nth
  FROM scored WHERE label = anchor_label),
ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM positives p JOIN scored s ON p.anchor = s.anchor AND s.label <> p.anchor_label
    AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
  WHERE nth <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5"""
