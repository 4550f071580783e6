"""Message and file routing (P15, P16); the same functions run on batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as FV


def route_message(text: Column) -> Column:
    """``non_text`` for a missing text (tested first), ``command`` for ``/...``, else ``question``."""
    return (F.when(text.isNull(), F.lit("non_text"))
            .when(text.startswith("/"), F.lit("command"))
            .otherwise(F.lit("question")))


def route_messages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Stateless routing with the command name; valid on a streaming DataFrame (append mode)."""
    t = F.col(text_col)
    return df.withColumn("route", route_message(t)).withColumn(
        "command", F.when(t.startswith("/"), F.regexp_extract(t, r"^/([^\s@]*)", 1)))


def route_file(path: Column) -> Column:
    """Case-sensitive extension test: sheets are analysed, documents stored, others rejected."""
    analyse = None
    for ext in FV.ANALYSE_EXTENSIONS:
        analyse = path.endswith(ext) if analyse is None else analyse | path.endswith(ext)
    store = None
    for ext in FV.STORE_EXTENSIONS:
        store = path.endswith(ext) if store is None else store | path.endswith(ext)
    return (F.when(analyse, F.lit("analyse")).when(store, F.lit("store")).otherwise(F.lit("reject")))
