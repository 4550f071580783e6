"""Registered queries of the text functions and document assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import documents as D
from ..operators.ordering import spread
from ..sources.tables import read_table
from .common import spread_partitions


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Text with URLs: page markup, its URL and trailing punctuation."""
    return read_table(spark, d, "pages").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("id"),
        F.concat_ws(" ", "html", "url").alias("_t")).select(
        "source", "id", F.concat(F.col("_t"), F.lit(", ok?")).alias("text"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents plus page texts with URLs, as (source, id, text)."""
    docs = read_table(spark, d, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(page_text(spark, d))


def clean_text(spark, d):
    """URL-preserving cleanup of every document and page text."""
    return spread(texts(spark, d), spread_partitions(spark)).select("source", "id", TX.clean_text(F.col("text")).alias("text"))


def newline_to_space(spark, d):
    """newlines to spaces in every document."""
    return read_table(spark, d, "documents").select("doc_id", TX.newline_to_space(F.col("text")).alias("text"))


def token_count(spark, d):
    """token counts of every document and page text."""
    return spread(texts(spark, d), spread_partitions(spark)).select("source", "id", TX.token_count(F.col("text")).alias("tokens"))


def money_format(spark, d):
    """part prices as money strings."""
    return read_table(spark, d, "part").select("p_partkey", TX.money(F.col("p_retailprice")).alias("price"))


def row_text(spark, d):
    """F7 + P7: each customer row's non-null cells as text."""
    c = read_table(spark, d, "customer")
    return c.select("c_custkey", TX.row_text(*c.columns).alias("text"))


def table_text(spark, d):
    """Each order's line items flattened to text, row-major."""
    li = spread(read_table(spark, d, "lineitem"), spread_partitions(spark))
    cells = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    # Line numbers repeat inside an order here, so all cells make the row order total.
    return D.table_text(li, ["l_orderkey"], cells, cells)


def document_text(spark, d):
    """Each conversation's turns joined into one document (both newline forms)."""
    conv = read_table(spark, d, "conversations")
    # One aggregation: the "newline after every part" form is the joined form plus one newline.
    return D.document_text(conv, ["conv_id"], ["turn"]).withColumn(
        "text_with_trailing_newline", F.concat(F.col("text"), F.lit("\n")))


def union_renumber(spark, d):
    """Customers and suppliers unioned by name with a fresh index."""
    cust = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    supp = read_table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return D.union_renumber([("customer", cust), ("supplier", supp)])


def conversation_piece() -> F.Column:
    """One turn as ``role: text`` plus a newline."""
    return F.concat(F.col("role"), F.lit(": "), F.coalesce(F.col("text"), F.lit("")), F.lit("\n"))


def running_context(spark, d):
    """Each turn with all earlier turns of its conversation."""
    conv = read_table(spark, d, "conversations")
    return D.running_context(conv, "conv_id", "turn", conversation_piece()).select(
        "conv_id", "turn", "context")


QUERIES = {
    "clean_text": clean_text,
    "newline_to_space": newline_to_space,
    "token_count": token_count,
    "money_format": money_format,
    "row_text": row_text,
    "table_text": table_text,
    "document_text": document_text,
    "union_renumber": union_renumber,
    "running_context": running_context,
}
