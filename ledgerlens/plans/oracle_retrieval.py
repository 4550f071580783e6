"""DuckDB SQL equivalents of the retrieval queries."""

from .. import fixed_values as FV
from ..operators.retrieval import DEFAULT_CLOSE, DEFAULT_INTRO, DEFAULT_OPEN, DEFAULT_QUESTION_PREFIX
from .oracle_patterns import TOKEN, WORD
from .retrieval_queries import RELEVANCE_THRESHOLD, SYSTEM_INSTRUCTION


def _s(text: str) -> str:
    """A DuckDB string expression for a Python string (newlines via chr(10))."""
    parts = text.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(parts) > 1 else quoted[0]


def _tok(expr: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({expr}, '{TOKEN}')), 0) AS BIGINT)"


QUERIES = """ex AS (SELECT label, UNNEST(range(len(embedding))) AS pos, UNNEST(embedding) AS v FROM embeddings),
sums AS (SELECT label, pos, sum(CAST(v AS DOUBLE)) AS s FROM ex GROUP BY label, pos),
q AS (SELECT label AS qid, list(s ORDER BY pos) AS qvec,
             printf('Which passages are about topic %d?', label) AS question FROM sums GROUP BY label),
corpus AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"""


def _ranked(k: int) -> str:
    return f"""{QUERIES},
scored AS (SELECT q.qid, c.vec_id,
                  list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.qvec) AS full_similarity
           FROM q, corpus c),
ranked AS (SELECT qid, vec_id, round(full_similarity, 6) AS similarity,
                  CAST(row_number() OVER (PARTITION BY qid ORDER BY round(full_similarity, 12) DESC NULLS LAST, vec_id)
                       AS INTEGER) AS rank
           FROM scored),
top AS (SELECT * FROM ranked WHERE rank <= {k})"""


def _pack_sql(budget: int, tag: str) -> str:
    """CTEs packing the ranked top passages to ``budget`` and assembling prompts (names end in tag)."""
    return f"""passages{tag} AS (SELECT t.*, d.text, {_tok(f"{_s(DEFAULT_OPEN)} || d.text || {_s(DEFAULT_CLOSE)}")} AS tokens
             FROM top t JOIN documents d ON t.vec_id = d.doc_id),
fixed{tag} AS (SELECT qid, question, {_tok(_s(DEFAULT_INTRO))} + {_tok(f"{_s(DEFAULT_QUESTION_PREFIX)} || question")} AS fixed_tokens FROM q),
cum{tag} AS (SELECT p.*, f.fixed_tokens,
               CAST(sum(tokens) OVER (PARTITION BY p.qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_tokens
        FROM passages{tag} p JOIN fixed{tag} f ON p.qid = f.qid),
packed{tag} AS (SELECT * FROM cum{tag} WHERE cum_tokens <= {budget} - fixed_tokens),
prompts{tag} AS (
  SELECT q.qid, q.question, CAST(coalesce(b.n, 0) AS BIGINT) AS n_passages,
         {_s(DEFAULT_INTRO)} || coalesce(b.body, '') || {_s(DEFAULT_QUESTION_PREFIX)} || q.question AS prompt
  FROM q LEFT JOIN (SELECT qid, count(*) AS n,
                           string_agg({_s(DEFAULT_OPEN)} || text || {_s(DEFAULT_CLOSE)}, '' ORDER BY rank) AS body
                    FROM packed{tag} GROUP BY qid) b ON q.qid = b.qid)"""


PACKED = f"""{_ranked(FV.DEFAULT_TOP_N)},
{_pack_sql(FV.DEFAULT_TOKEN_BUDGET, "")}"""


def _words(expr: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({expr}), '{WORD}'))"

PIECE = "role || ': ' || coalesce(text, '') || chr(10)"

SQL = {
    "cosine_topk": f"WITH {_ranked(FV.DEFAULT_TOP_N)}\nSELECT qid, rank, vec_id, similarity FROM top",
    "cosine_topk_indexed": f"WITH {_ranked(FV.DEFAULT_TOP_N)}\nSELECT qid, rank, vec_id, similarity FROM top",
    "cosine_topk_single": f"""WITH ex AS (SELECT UNNEST(range(len(embedding))) AS pos, UNNEST(embedding) AS v FROM embeddings),
g AS (SELECT list(s ORDER BY pos) AS qvec FROM (SELECT pos, sum(CAST(v AS DOUBLE)) AS s FROM ex GROUP BY pos)),
corpus AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))
SELECT -1 AS qid, c.vec_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), g.qvec), 6) AS similarity
FROM corpus c, g ORDER BY round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), g.qvec), 12) DESC NULLS LAST, vec_id LIMIT {FV.DEFAULT_TOP_N}""",
    "relatedness_report": f"""WITH {_ranked(FV.REPORT_TOP_N)}
SELECT t.qid, t.rank, t.vec_id, CAST(CAST(CAST(t.similarity AS DECIMAL(10,6)) AS DECIMAL(10,3)) AS VARCHAR) AS relatedness, d.text
FROM top t JOIN documents d ON t.vec_id = d.doc_id""",
    "vector_long": """SELECT vec_id, CAST(UNNEST(range(len(embedding))) AS INTEGER) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS value
FROM embeddings""",
    "vector_csv_roundtrip": """SELECT e.vec_id, CASE e.vec_id % 4 WHEN 0 THEN ' ' || d.text || '  ' WHEN 1 THEN ''
       WHEN 2 THEN NULL ELSE d.text END AS text, CAST(e.embedding AS DOUBLE[]) AS embedding
FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id""",
    "context_pack": f"WITH {PACKED}\nSELECT qid, rank, vec_id, tokens, cum_tokens FROM packed",
    "retrieval_prompt": f"WITH {PACKED}\nSELECT qid, question, n_passages, prompt FROM prompts",
    "relevance_gate": f"""WITH {PACKED},
{_pack_sql(FV.SUMMARY_TOKEN_TARGET, "_small")},
best AS (SELECT qid, similarity AS top_similarity FROM top WHERE rank = 1)
SELECT p.qid, b.top_similarity, coalesce(b.top_similarity >= {RELEVANCE_THRESHOLD}, false) AS relevant,
       CASE WHEN coalesce(b.top_similarity >= {RELEVANCE_THRESHOLD}, false) THEN p.prompt
            ELSE coalesce(s.prompt, '') END AS context
FROM prompts p LEFT JOIN best b ON p.qid = b.qid LEFT JOIN prompts_small s ON p.qid = s.qid""",
    "extractive_context": f"""WITH qs AS (
  SELECT conv_id, max(turn) AS q_turn, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
lines AS (
  SELECT c.conv_id, c.turn AS ordinal, UNNEST(range(len(string_split(c.text, chr(10))))) AS line_no,
         UNNEST(string_split(c.text, chr(10))) AS line, {_words('qs.question')} AS qw
  FROM conversations c JOIN qs ON c.conv_id = qs.conv_id WHERE c.turn <> qs.q_turn),
scored AS (SELECT conv_id, ordinal, line_no, line,
                  len(list_intersect({_words('line')}, qw)) AS score, {_tok('line')} AS tokens FROM lines),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, ordinal, line_no) AS rank
           FROM scored WHERE score > 0),
cum AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_tokens
        FROM ranked WHERE rank <= {FV.SUMMARY_TOKEN_TARGET}),
kept AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY ordinal, line_no) AS context, count(*) AS n_lines,
                CAST(max(cum_tokens) AS BIGINT) AS tokens
         FROM cum WHERE cum_tokens <= {FV.SUMMARY_TOKEN_TARGET} GROUP BY conv_id)
SELECT conv_id, coalesce(context, '') AS context, coalesce(n_lines, 0) AS n_lines, coalesce(tokens, 0) AS tokens
FROM qs LEFT JOIN kept USING (conv_id)""",
    "prompt_messages": f"""WITH ctx AS (
  SELECT conv_id, turn, role, text, coalesce(string_agg({PIECE}, '') OVER (PARTITION BY conv_id ORDER BY turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations),
asks AS (SELECT * FROM ctx WHERE role = 'user' AND text IS NOT NULL AND NOT starts_with(text, '/'))
SELECT conv_id, turn, 0 AS position, 'system' AS role, {_s(SYSTEM_INSTRUCTION)} || context AS content FROM asks
UNION ALL SELECT conv_id, turn, 1, 'user', text FROM asks""",
}
