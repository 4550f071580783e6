"""DuckDB SQL equivalents of the application-layer queries."""

from decimal import Decimal

from ..fixed_values import TOTAL_COLUMNS
from . import standins as S
from .oracle_citations import BASE, CITATIONS, COUNTED, FOCUS, TOTALS
from .oracle_citations import SQL as CITATION_SQL
from .app_queries import SECTION_INSTRUCTION
from .oracle_patterns import TOKEN
from .oracle_retrieval import PIECE, _s


def _tok(expr: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({expr}, '{TOKEN}')), 0) AS BIGINT)"


def _per_token(price: float) -> str:
    return f"CAST({Decimal(str(price)) / 1000} AS DECIMAL(19,13))"


PRICES = ", ".join(f"('{m}', {_per_token(p)}, {_per_token(c)})" for m, p, c in S.PRICES)

TABLES_TEXT = " || ".join(f"'{n} ' || printf('%.2f', CAST({n} AS DOUBLE)) || ' '" for n in TOTAL_COLUMNS)

ROUTE_SQL = """WITH m AS (
  SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 7 = 0 THEN '/start' ELSE text END AS text
  FROM conversations)
SELECT conv_id, turn,
       CASE WHEN text IS NULL THEN 'non_text' WHEN starts_with(text, '/') THEN 'command' ELSE 'question' END AS route,
       CASE WHEN starts_with(text, '/') THEN regexp_extract(text, '^/([^\\s@]*)', 1) END AS command
FROM m"""

SQL = {
    "route_messages_stream": ROUTE_SQL,
    "route_messages": ROUTE_SQL,
    "route_files": """WITH f AS (
  SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.docx' WHEN 2 THEN '.XLSX' ELSE '.pdf' END AS path
  FROM pages)
SELECT page_id, path,
       CASE WHEN suffix(path, '.xlsx') OR suffix(path, '.xls') THEN 'analyse'
            WHEN suffix(path, '.doc') OR suffix(path, '.docx') THEN 'store' ELSE 'reject' END AS action
FROM f""",
    "usage_cost": f"""WITH u AS (
  SELECT role AS model,
         CAST(coalesce(sum({_tok('text')}) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prompt_tokens,
         {_tok('text')} AS completion_tokens
  FROM conversations),
t AS (SELECT model, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
             CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM u GROUP BY model),
p(model, pp, cp) AS (VALUES {PRICES})
SELECT t.model, t.requests, t.prompt_tokens, t.completion_tokens,
       CAST(t.prompt_tokens * p.pp + t.completion_tokens * p.cp AS DOUBLE) AS cost
FROM t LEFT JOIN p ON t.model = p.model""",
    "report_requests": f"""WITH {COUNTED},
{TOTALS},
tt AS (SELECT {TABLES_TEXT} AS tables_text FROM totals),
ctx AS (
  SELECT conv_id, turn, role, text, coalesce(string_agg({PIECE}, '') OVER (PARTITION BY conv_id ORDER BY turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS previous_text FROM conversations),
r AS (
  SELECT conv_id, turn, {_s(SECTION_INSTRUCTION)} || chr(10) || 'Sections written so far:' || chr(10) || previous_text
         || chr(10) || 'Data tables:' || chr(10) || (SELECT tables_text FROM tt) || chr(10) || 'Task: ' || text AS request
  FROM ctx WHERE role = 'user' AND text IS NOT NULL)
SELECT conv_id, turn, request, {_tok('request')} AS request_tokens FROM r""",
    "sample_n": """SELECT * FROM lineitem ORDER BY md5('7-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey
       || '-' || l_suppkey), l_extendedprice, l_quantity LIMIT 10""",
    "scan_skip_preamble": """WITH n AS (SELECT CAST(ceil(count(*) / 500.0) AS BIGINT) AS files FROM customer)
SELECT row_number() OVER (PARTITION BY c_custkey % files ORDER BY c_custkey) - 1 AS ordinal,
       CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
FROM customer, n""",
    "scan_wholetext": """SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars,
       CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines
FROM documents GROUP BY source""",
    "sink_overwrite": f"WITH {CITATIONS},\n{FOCUS}\nSELECT * FROM focus",
    "file_drop_refresh": CITATION_SQL["citations_by_type_scope"],
    "stream_counts": f"""{BASE}
SELECT violation_type, count(*) FILTER (WHERE scope = 'local') AS local,
       count(*) FILTER (WHERE scope = 'state') AS state
FROM classified WHERE violation_type IS NOT NULL GROUP BY violation_type""",
}
