"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

from . import credentials, url_filter
from .common import LOWER, UPPER
from .line_dedup import MIN_DOCS

OP2 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key AS common_key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(common_key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common_key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = common_key GROUP BY doc_id
"""

def _op7() -> str:
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    hit = "CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){}([^a-z0-9]|$)') THEN {} ELSE 0 END"
    strict = " + ".join(hit.format(t, 1) for t in url_filter.STRICT_TERMS)
    soft = " + ".join(hit.format(t, 1) for t in url_filter.SOFT_TERMS)
    weight = " + ".join(hit.format(t, float(w)) for t, w in url_filter.SOFT_TERMS.items())
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    return f"""
WITH u AS (
  SELECT page_id, {low} AS low,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS ruled
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
c AS (SELECT *, CAST({strict} AS BIGINT) AS n_strict, CAST({soft} AS BIGINT) AS n_soft,
             CAST({weight} AS DOUBLE) AS soft_weight FROM u)
SELECT page_id, host, path, rule, coalesce(ruled,
         CASE WHEN n_strict > 0 OR soft_weight >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft, soft_weight
FROM c LEFT JOIN best USING (page_id)
"""


def _op10() -> str:
    def parts(kind: int, pattern: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""SELECT doc_id, owner, {kind} AS kind,
          string_split(regexp_replace(body, '{quoted}', '|\\0|', 'g'), '|') AS ps FROM t""".replace("|", "' || chr(57344) || '")
    kinds = [credentials.ASSIGN, credentials.ACCESS, credentials.HEX, credentials.CANDIDATE]
    union = " UNION ALL ".join(parts(k, p.replace("|", "~")).replace("~", "|") for k, p in enumerate(kinds))
    assign = credentials.ASSIGN.replace("'", "''")
    return f"""
WITH t AS (SELECT doc_id, source AS owner, translate(coalesce(text, ''), chr(57344), chr(57345)) AS body FROM documents),
q AS ({union}),
p AS (SELECT doc_id, owner, kind, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM q),
m AS (SELECT *, CAST(sum(length(part)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM p),
s AS (
  SELECT doc_id, owner, kind, part, stop - length(part) AS start, stop FROM m WHERE i % 2 = 0 AND CASE kind
    WHEN 0 THEN length(regexp_extract(part, '{assign}', 2)) >= {credentials.ASSIGN_CHARS}
    WHEN 3 THEN regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Za-z]')
                AND len(list_distinct(string_split(part, ''))) >= {credentials.MIN_DISTINCT}
    ELSE true END),
o AS (SELECT part, count(DISTINCT owner) + CAST(bool_or(owner IS NULL) AS INT) AS owners FROM s WHERE kind = 3 GROUP BY part),
a AS (
  SELECT s.*, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop AS span,
         kind < 3 OR owners <= {credentials.MAX_OWNERS} AS shown
  FROM s LEFT JOIN o ON s.part = o.part AND kind = 3),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3) AS base,
         string_agg(span, ',' ORDER BY start, kind, stop) FILTER (WHERE shown) AS spans,
         count(*) FILTER (WHERE kind = 3 AND shown) AS n_live, count(*) FILTER (WHERE NOT shown) AS n_examples
  FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_examples, 0) AS n_examples
FROM documents LEFT JOIN g USING (doc_id)
"""


OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score,
       s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score
  AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""

OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run FROM w),
l AS (SELECT run, min(doc_id) AS least FROM h GROUP BY run),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN l USING (run) WHERE least < doc_id),
k AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d)
SELECT d.doc_id, CAST(max(len(ws)) AS BIGINT) AS n_words, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY k.i) FILTER (WHERE k.i IS NOT NULL AND g.i IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN g ON k.doc_id = g.doc_id AND k.i = g.i
GROUP BY d.doc_id
"""

SQL = {"op2_line_dedup": OP2, "op7_url_filter": _op7(), "op10_secret_scan": _op10(), "op11_hard_negatives": OP11,
       "op12_substring_dedup": OP12}
