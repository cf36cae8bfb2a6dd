"""SQL (DuckDB) for the queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"

DECONTAMINATE = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM iw WHERE len(w) > 0)
),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM dw WHERE len(w) > 0),
win AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM pos CROSS JOIN (SELECT DISTINCT n FROM pat) WHERE p + n - 1 <= len(w)
),
hit AS (SELECT doc_id, p, win.n, item FROM win JOIN pat ON win.n = pat.n AND win.s = pat.s),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS s FROM pos WHERE p + 19 <= len(w)),
later AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM win),
word AS (
  SELECT pos.doc_id, pos.p, w[pos.p] AS x,
    coalesce(max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY pos.doc_id ORDER BY pos.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM pos LEFT JOIN later ON pos.doc_id = later.doc_id AND pos.p = later.p
),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM word GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_SPACED}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM inter JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS size,
    md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR), text)) AS k
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CAST(2 * source_size AS DOUBLE) AS top,
    1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM r
),
f AS (
  SELECT *,
    total - coalesce(sum(top) OVER (ORDER BY top / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    CAST(sum(weight) OVER (ORDER BY top / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open
  FROM w
),
g AS (SELECT *, top <= rest * weight / open AS full_up FROM f),
t AS (
  SELECT source, source_size, CASE WHEN full_up THEN top
    ELSE (total - coalesce(sum(CASE WHEN full_up THEN top END) OVER (), 0)) * weight / CAST(sum(CASE WHEN NOT full_up THEN weight END) OVER () AS DOUBLE) END AS target
  FROM g
),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM t),
c AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS rounds FROM b),
o AS (
  SELECT d.*, c.source_size, c.target, c.rounds, c.budget - c.rounds * c.source_size AS last,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k) AS BIGINT) AS upto, CAST(sum(size) OVER (PARTITION BY d.source, k) AS BIGINT) AS tied
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target,
  CAST(rounds * size + CASE WHEN upto <= last THEN size WHEN upto - tied >= last THEN 0 ELSE size * (last - (upto - tied)) // greatest(tied, 1) END AS BIGINT) AS taken
FROM o
"""

RANKED = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
b AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark
),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d WHERE len(terms) > 0),
u AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
e AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM u WHERE term IN (SELECT term FROM b) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM e CROSS JOIN total GROUP BY term, docs),
s AS (
  SELECT b.item_id, e.doc_id, CAST(sum(w.weight * ((1000000000 * e.tf) // (1000 * e.tf + 8 * (10 + (90 * e.n * total.docs) // total.words)))) AS BIGINT) AS score
  FROM e JOIN w USING (term) JOIN b USING (term) CROSS JOIN total GROUP BY b.item_id, e.doc_id
),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
