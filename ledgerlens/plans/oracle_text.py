"""DuckDB SQL equivalents of the text queries."""

from .oracle_patterns import CLEAN, TOKEN

TEXTS = """texts AS (
  SELECT 'documents' AS source, doc_id AS id, text FROM documents
  UNION ALL
  SELECT 'pages', page_id, concat_ws(' ', html, url) || ', ok?' FROM pages)"""

SQL = {
    "clean_text": f"""WITH {TEXTS}
SELECT source, id, regexp_replace(regexp_replace(regexp_replace(text, '{CLEAN}', '\\1', 'g'),
       '[\\n\\t]+', '', 'g'), ' {{5,}}', ' ', 'g') AS text FROM texts""",
    "newline_to_space": "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents",
    "token_count": f"""WITH {TEXTS}
SELECT source, id, CAST(coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS BIGINT) AS tokens FROM texts""",
    "money_format": "SELECT p_partkey, printf('$%,.2f', CAST(CAST(p_retailprice AS DECIMAL(20,2)) AS DOUBLE)) AS price FROM part",
    "row_text": """SELECT c_custkey, concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR),
       CAST(c_acctbal AS VARCHAR), c_mktsegment) AS text FROM customer""",
    "table_text": """SELECT l_orderkey, string_agg(concat_ws('', CAST(l_linenumber AS VARCHAR) || ' ', CAST(l_partkey AS VARCHAR) || ' ',
       CAST(l_quantity AS VARCHAR) || ' ', CAST(l_extendedprice AS VARCHAR) || ' ', l_returnflag || ' '), '' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) AS text
FROM lineitem GROUP BY l_orderkey""",
    "document_text": """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text,
       string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text_with_trailing_newline
FROM conversations GROUP BY conv_id""",
    "union_renumber": """WITH u AS (
  SELECT 'customer' AS source, 0 AS part, c_custkey AS ordinal, c_name AS name, c_acctbal AS acctbal, c_mktsegment FROM customer
  UNION ALL
  SELECT 'supplier', 1, s_suppkey, s_name, s_acctbal, NULL FROM supplier)
SELECT ordinal, name, acctbal, c_mktsegment, source,
       CAST(row_number() OVER (ORDER BY part, ordinal) - 1 AS BIGINT) AS idx FROM u""",
    "running_context": """SELECT conv_id, turn, coalesce(string_agg(role || ': ' || coalesce(text, '') || chr(10), '') OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
FROM conversations""",
}
