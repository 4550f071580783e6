"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread_partitions(spark: SparkSession) -> int | None:
    """Partitions over which a caller wants CPU-heavy text queries spread (unset: the scan's own splits).

    For inputs of one row group, whose scan is one task; a large table is best left as it is.
    """
    asked = spark.conf.get("spark.ledgerlens.spreadPartitions", None)
    return int(asked) if asked else None


def money_out(df: DataFrame) -> DataFrame:
    """Cast every decimal column to double on output (decimals are exact inside)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f.name) for f in df.schema.fields])
