"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from ..sources.tables import read_table

#: The white space of the word and line contracts: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with this package shipped to the workers that will read it."""
    ship_package(spark)
    return read_table(spark, sf_dir, name)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def id_remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def document_key() -> list[Column]:
    """Two columns, never NULL, that identify a document by its id and its whole text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_doc"),
            F.xxhash64(F.lit("text"), F.col("text")).alias("_text_hash")]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared scratch folder and read back.

    Cuts the lineage with files that every executor sees, so that a lost
    executor costs a re-read and never a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know ASCII letters and exactly these six
    white-space characters only.
    """
    return (text or "").encode("utf-8").lower().split()
