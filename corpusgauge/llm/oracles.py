"""DuckDB SQL of the queries that SQL can express on whole tables.

The others are held against brute force in the tests: a learned list (4), greedy tiling
(5), a schedule and a shuffle by Spark's hash (3, 6), a tokenizer (8), trained trees (9),
whitening (12), random vectors (13).
"""

from __future__ import annotations

from corpusgauge.llm import line_dedup as L
from corpusgauge.llm.frames import WORD

_PIECES = ((L.COMMENT, "''"), (L.SCRIPT, "chr(10)"), (L.STYLE, "chr(10)"), (L.BLOCK, "chr(10)"), (L.TAG, "''"), (L.BLANKS, "' '"))


def _page_text() -> str:
    text = "coalesce(html, '')"
    for pattern, to in _PIECES:
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    return text


_LINE_DEDUP = f"""
WITH pages_ AS (
  SELECT row_number() OVER () AS r, page_id, regexp_extract(lower(coalesce(url, '')), '{L.HOST}', 1) AS host,
    list_filter(list_transform(string_split({_page_text()}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls
  FROM pages
),
hosts AS (SELECT host, count(*) AS n FROM pages_ GROUP BY host),
held AS (
  SELECT host, line, count(*) AS c FROM (SELECT DISTINCT r, host, unnest(ls) AS line FROM pages_) GROUP BY host, line
),
often AS (
  SELECT host, list(line) AS bad FROM held JOIN hosts USING (host)
  WHERE c >= 2 AND c > CAST({L.RATIO} AS DOUBLE) * n GROUP BY host
),
kept AS (
  SELECT page_id, host, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(bad, []), x)) AS ks
  FROM pages_ LEFT JOIN often USING (host)
)
SELECT page_id, host, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(ks) AS BIGINT) AS n_dropped,
  coalesce(array_to_string(ks, chr(10)), '') AS text
FROM kept
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_JACCARD_JOIN = f"""
WITH RECURSIVE words_ AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws
  FROM documents
),
shingles AS (
  SELECT DISTINCT r, array_to_string(ws[s : s + 4], ' ') AS g FROM words_, unnest(range(1, len(ws) - 3)) AS u(s)
  UNION ALL
  SELECT r, array_to_string(ws, ' ') FROM words_ WHERE len(ws) BETWEEN 1 AND 4
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (
  SELECT a.r AS x, b.r AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * i >= 75 * (p.n + q.n - i)
),
reach AS (
  SELECT r AS x, r AS y FROM words_
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT any_value(w.doc_id) AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(v.doc_id) AS component_id
FROM reach JOIN words_ w ON w.r = reach.x JOIN words_ v ON v.r = reach.y LEFT JOIN sizes ON sizes.r = reach.x
GROUP BY reach.x
"""

_SUBSTRING_DEDUP = f"""
WITH words_ AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
),
windows AS (
  SELECT r, doc_id, s, array_to_string(ws[s : s + 49], ' ') AS k FROM words_, unnest(range(1, len(ws) - 48)) AS u(s)
),
owners AS (SELECT k, min(doc_id) AS owner FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT r, s + i AS p FROM windows JOIN owners USING (k), unnest(range(0, 50)) AS t(i) WHERE doc_id > owner
),
each_word AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM words_),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS text FROM each_word ANTI JOIN gone USING (r, p) GROUP BY r),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM words_ LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

_WARC_STORE = """
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS b, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS origin FROM pages
),
rated AS (SELECT *, strlen(b) >= 1000 AND page_id <> origin AS again FROM bodies)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN origin END AS refers_to
FROM rated
"""

_HARD_NEGATIVES = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
hard AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS k
  FROM near JOIN scores USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM hard WHERE k <= 10
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": _LINE_DEDUP,
    "op2_jaccard_join": _JACCARD_JOIN,
    "op7_substring_dedup": _SUBSTRING_DEDUP,
    "op10_warc_store": _WARC_STORE,
    "op11_hard_negatives": _HARD_NEGATIVES,
}
