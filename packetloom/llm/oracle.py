"""DuckDB SQL for the corpus queries whose results SQL can state."""

from .decontamination import ORACLE_SQL as CONTAINED

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"""WITH t AS (SELECT doc_id, trim(coalesce(text, ''), {_BLANK}) AS t FROM documents),
w AS (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') END AS w FROM t)"""

SUFFIX_DEDUP = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
wins AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM t WHERE n >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS p FROM again),
spans AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone),
counts AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE q IS NULL OR q < p - 1) AS n_spans FROM spans GROUP BY doc_id),
bytes AS (SELECT doc_id, unnest(range(0, n)) AS p, h FROM t),
kept AS (SELECT b.doc_id, string_agg(substr(h, CAST(2 * b.p + 1 AS BIGINT), 2), '' ORDER BY b.p) AS k FROM bytes b LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.p = b.p WHERE g.p IS NULL GROUP BY b.doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM t LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)"""

SUBSTRING_DEDUP = _WORDS + """,
wins AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
many AS (SELECT s FROM wins GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM wins JOIN many USING (s)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT x.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS k FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

NEAR_DEDUP = f"""WITH RECURSIVE t AS (SELECT doc_id, trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_BLANK}) AS t FROM documents),
w AS (SELECT doc_id, regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') AS w FROM t WHERE t <> ''),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id),
component AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d JOIN component ON id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id"""

SQL = {"op1_suffix_dedup": SUFFIX_DEDUP, "op3_substring_dedup": SUBSTRING_DEDUP, "op4_near_dedup": NEAR_DEDUP, "op10_decontamination": CONTAINED}
