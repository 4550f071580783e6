"""ledgerlens: revenue analysis of coded records and text retrieval on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a few DataFrames in,
one out) built from Spark SQL expressions, so Catalyst can prune, push down and
plan it. Python runs only inside Arrow-batched ``mapInArrow``/``mapInPandas``/
``applyInPandas`` kernels where no built-in expression exists (vector top-k,
injected model providers).

Modules
-------
sources.tables      explicit-schema table scans
sources.files       preamble CSV, vector CSV, whole-text files, replace / build-once sinks
functions.text      cleanup, token count, money, row text, period months, timestamps
operators.classify  agency filter, prefix classifier (CASE and rule-table join), scope
operators.violations reference merge, exact counts, fines, metrics, fill-missing, membership
operators.reports   scope pivots, span, totals, report tables, impact, calculation trace
operators.documents document / table text, union with a fresh index, running context
operators.retrieval exact top-k kernel, packing, prompts, relevance gate, extractive context
operators.models    batch completion with fallback, embeddings, section writer, usage cost
operators.routing   message and file routing (batch or stream)
operators.ordering  distributed dense index, take-until-null, spread for few-split inputs
streaming.streams   routing stream, file-drop refresh, running counts
plans               stand-in inputs, registered queries, DuckDB oracle SQL
"""

__version__ = "0.1.0"
