"""Registered queries of the application layer: routing (P15, P16, X1), usage cost (A10),
section requests (M7), batch model calls (M1, M4), sampling (T4), file sources and
sinks (S2, S5, S8, S12) and streams (X2, X3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as FV
from ..functions.text import token_count
from ..operators import classify as C
from ..operators import models as M
from ..operators import reports as R
from ..operators.documents import running_context
from ..operators.ordering import running_sum_before, spread
from ..operators.routing import route_file, route_messages
from ..session import scratch_path
from ..sources import files as FS
from ..sources.sheets import read_sheets
from ..sources.tables import read_table, stream_path
from ..sources.versions import read_merged
from ..streaming import streams as ST
from . import citation_queries as CQ
from . import standins as S
from .common import spread_partitions
from .text_queries import conversation_piece

SECTION_INSTRUCTION = ("You write one section of a short memo about the analysis results, "
                       "in plain language and without repeating earlier sections.")


def as_messages(conv: DataFrame) -> DataFrame:
    """Chat messages from conversation turns, with some turned into commands and some into
    non-text (stateless, so it runs on a batch or a stream)."""
    text = (F.when(F.col("turn") % 5 == 4, F.lit(None).cast("string"))
            .when(F.col("turn") % 7 == 0, F.lit("/start")).otherwise(F.col("text")))
    return conv.select("conv_id", "turn", "role", text.alias("text"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Chat messages built from the conversations table."""
    return as_messages(read_table(spark, d, "conversations"))


def route_messages_q(spark, d):
    """Every message routed (command, question, non-text)."""
    return route_messages(messages(spark, d)).select("conv_id", "turn", "route", "command")


def route_messages_stream(spark, d):
    """X1 on Structured Streaming: the files of the conversations table (one, or a folder of them)
    arrive as a stream, are routed turn by turn (append mode) into a table, and the table is read
    back (by its schema, as a stream without files writes none)."""
    from ..sources.tables import SCHEMAS
    schema = route_messages_q(spark, d).schema
    out = scratch_path(spark, "routed")
    ST.route_stream(spark, stream_path(d, "conversations"), SCHEMAS["conversations"], out, prepare=as_messages)
    return spark.read.schema(schema).parquet(out)


def uploaded_files(spark: SparkSession, d: str) -> DataFrame:
    """Uploaded file paths built from the pages table."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".xlsx", ".docx", ".XLSX", ".pdf")]),
                       (F.col("page_id") % 4 + 1).cast("int"))
    return read_table(spark, d, "pages").select("page_id", F.concat(F.col("url"), ext).alias("path"))


def route_files_q(spark, d):
    """Every uploaded file routed by extension."""
    return uploaded_files(spark, d).select("page_id", "path", route_file(F.col("path")).alias("action"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    """One request per turn: the model is the role; the prompt is everything said before.

    The running prompt-token sum is chunked, so a very long conversation is
    split over many tasks instead of one window partition.
    """
    conv = read_table(spark, d, "conversations").withColumn("_tok", token_count(F.col("text")))
    summed = running_sum_before(conv, "conv_id", "turn", "_tok", "prompt_tokens")
    return summed.select(F.col("role").alias("model"), "prompt_tokens", F.col("_tok").alias("completion_tokens"))


def usage_cost_q(spark, d):
    """A10: tokens and cost per model."""
    return M.usage_cost(usage(spark, d), S.prices(spark))


def tables_text(spark: SparkSession, d: str) -> DataFrame:
    """S7 of the one-row totals table: ``name value`` cells, a space after each."""
    totals = R.metrics_totals(CQ._metrics(spark, d))
    cells = []
    for name in FV.TOTAL_COLUMNS:
        cells += [F.lit(name + " "), F.format_string("%.2f", F.col(name).cast("double")), F.lit(" ")]
    return totals.select(F.concat(*cells).alias("tables_text"))


def report_requests(spark, d):
    """M7: section requests carrying earlier sections and the result tables.

    Token counts add up over the pieces of a request, so the earlier sections are counted by the scan that builds
    their text, and only the requests themselves are built as text.
    """
    conv = read_table(spark, d, "conversations")
    sections = running_context(conv, "conv_id", "turn", conversation_piece(), name="previous_text",
                               wanted=(F.col("role") == "user") & F.col("text").isNotNull(),
                               count=token_count(conversation_piece()), count_name="previous_tokens")
    tables = tables_text(spark, d).select(F.struct("tables_text", token_count(F.col("tables_text")).alias("n"))).scalar()
    rows = sections.withColumn("_tables", tables)
    fixed = M.section_request(F.lit(SECTION_INSTRUCTION), F.lit(""), F.lit(""), F.lit(""))
    return rows.select(
        "conv_id", "turn",
        M.section_request(F.lit(SECTION_INSTRUCTION), F.col("previous_text"), F.col("_tables.tables_text"),
                          F.col("text")).alias("request"),
        (token_count(fixed) + F.col("previous_tokens") + F.col("_tables.n") + token_count(F.col("text")))
        .alias("request_tokens"))


def embed_batch(spark, d):
    """M1: every document embedded (Spark ML hashing embeddings)."""
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"), spread_partitions(spark))
    return M.embed_hashing(docs, "text").select("doc_id", "embedding")


def sample_n(spark, d, n: int = 10, seed: int = 7):
    """T4: a repeatable sample of n rows: order by a seeded digest of the row's keys, keep n."""
    li = read_table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return li.orderBy(digest, "l_extendedprice", "l_quantity").limit(n)


def scan_skip_preamble(spark, d, rows_per_file: int = 500):
    """S2 over CSV files that each start with a banner row and a header row."""
    cust = read_table(spark, d, "customer")
    n_files = -(-cust.count() // rows_per_file)
    cols = cust.columns
    data = cust.select((F.col("c_custkey") % n_files).alias("_part"), F.col("c_custkey").alias("_ord"),
                       F.to_csv(F.struct(*cols)).alias("value"))
    first = spark.range(n_files).select(F.col("id").alias("_part"), F.explode(F.array(
        F.struct(F.lit(-2).cast("long").alias("_ord"), F.lit("Customer extract (generated), do not edit").alias("value")),
        F.struct(F.lit(-1).cast("long").alias("_ord"), F.lit(",".join(cols)).alias("value")))).alias("r")).select(
        "_part", "r._ord", "r.value")
    path = scratch_path(spark, "preamble_csv")
    (first.unionByName(data).repartition("_part").sortWithinPartitions("_part", "_ord").select("_part", "value")
     .write.partitionBy("_part").text(path))
    return read_sheets(spark, path).drop("source_file")


def scan_wholetext(spark, d):
    """Files read whole; characters and lines of each source, however its files were cut."""
    docs = read_table(spark, d, "documents").select("source", "doc_id", "text")
    path = scratch_path(spark, "wholetext")
    # No shuffle: each task writes one file per source it holds, so no file
    # (and no task) grows with a hot source beyond one input split.
    (docs.sortWithinPartitions("source", "doc_id").select("source", "text")
     .write.partitionBy("source").text(path))
    whole = FS.read_wholetext(spark, path)
    return whole.groupBy(F.regexp_extract("file_path", "/source=([^/]*)/", 1).alias("source")).agg(
        F.sum(F.length("text")).alias("n_chars"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_lines"))


def sink_overwrite(spark, d):
    """S8 + S12: the focus table is built once and reused; its counts replace an older table."""
    path = scratch_path(spark, "focus_citations")
    FS.build_once(spark, path, lambda: CQ._focus(spark, d))
    focus = FS.build_once(spark, path, lambda: CQ._focus(spark, d).limit(0))  # reused, not rebuilt
    out = scratch_path(spark, "focus_copy")
    FS.replace_table(focus.select("l_orderkey"), out)
    FS.replace_table(focus, out)
    return FS.read_current(spark, out)


def _classify(df: DataFrame) -> DataFrame:
    return C.classify_prefix(C.agency_filter(df, S.FOCUS_AGENCY), "violation_code", S.BRAND_RULES,
                             S.BRAND_DEFAULT)


def stream_counts(spark, d):
    """Lineitem files arrive as a stream; each is joined to the static orders and
    parts, classified, and counted by (type, scope) in update mode; the counts that a batch
    changed are merged into the table by type."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    p = read_table(spark, d, "part").select("p_partkey", "p_brand")
    from ..sources.tables import SCHEMAS
    li = (spark.readStream.schema(SCHEMAS["lineitem"]).option("pathGlobFilter", "lineitem.parquet").parquet(d)
          .select("l_orderkey", "l_linenumber", "l_partkey"))
    cites = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(
        F.col("o_orderpriority").alias("department"), F.col("p_brand").alias("violation_code"))
    out = scratch_path(spark, "stream_counts")
    ST.update_mode_to_table(ST.running_counts(_classify(cites)), ["violation_type"], out)
    return read_merged(spark, out)


def file_drop_refresh(spark, d):
    """Two uploads land in a drop folder; the analysis is recomputed from the newest, all its files together."""
    drop = scratch_path(spark, "drop")
    cites = S.citations(spark, d).select("l_orderkey", "l_linenumber", "department", "violation_code")
    older = S.citations(spark, d).filter(F.year("violation_date") < 1998).select(*cites.columns)
    older.write.parquet(f"{drop}/upload-1")
    cites.repartition(4).write.parquet(f"{drop}/upload-2")
    out = scratch_path(spark, "refresh_out")
    ST.file_drop_refresh(spark, f"{drop}/*", cites.schema,
                         lambda df: R.counts_by_type_scope(_classify(df)), out)
    return FS.read_current(spark, out).drop("upload")


QUERIES = {
    "route_messages": route_messages_q,
    "route_messages_stream": route_messages_stream,
    "route_files": route_files_q,
    "usage_cost": usage_cost_q,
    "report_requests": report_requests,
    "embed_batch": embed_batch,
    "sample_n": sample_n,
    "scan_skip_preamble": scan_skip_preamble,
    "scan_wholetext": scan_wholetext,
    "sink_overwrite": sink_overwrite,
    "stream_counts": stream_counts,
    "file_drop_refresh": file_drop_refresh,
}
