"""Stand-in inputs built from the driver tables (TPC-H-like star schema + text tables).

Every stand-in reads whole tables; the few literal tables here are parameters
(rules, fines, prices, rates), never the data being analysed.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import param_table
from ..sources.tables import read_table

# Parameters of the stand-in analysis (ours, chosen for the driver tables).
FOCUS_AGENCY = "1-URGENT"
LOCAL_PREFIX = "Brand#1"
# Overlapping on purpose: 'Brand#1' is a prefix of 'Brand#11', so rule order matters.
BRAND_RULES = [
    ("Brand#11", 157.50, "A", "local"),
    ("Brand#1", 302.50, "A", "state"),
    ("Brand#2", 227.50, "B", "local"),
]
BRAND_DEFAULT = (302.50, "C", "state")
# Fines sheet rows by position; one missing state fine.
FINES = [
    (0, "ECONOMY", 157.50, 302.50),
    (1, "SMALL", 207.50, 302.50),
    (2, "STANDARD", 227.50, None),
    (3, "MEDIUM", 257.50, 302.50),
    (4, "LARGE", 607.50, 627.50),
    (5, "PROMO", 157.50, 302.50),
]
COLLECTION_RATE = 0.65
# Prices per 1,000 tokens, keyed by the model (here: the speaking role).
PRICES = [
    ("user", 0.01, 0.03),
    ("assistant", 0.0005, 0.0015),
]


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Citation rows: one per line item, with the order's priority as department,
    the part's brand as violation code and the order date as violation date."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    p = read_table(spark, d, "part").select("p_partkey", "p_brand")
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
            .select("l_orderkey", "l_linenumber", F.col("o_orderpriority").alias("department"),
                    F.col("p_brand").alias("violation_code"), F.col("o_orderdate").alias("violation_date"),
                    F.col("l_extendedprice").alias("price")))


def violation_types(spark: SparkSession, d: str) -> DataFrame:
    """Violation sheet: code = brand, violation = part type, ordinal = part key."""
    return read_table(spark, d, "part").select(
        F.col("p_brand").alias("ref"), F.col("p_type").alias("violation"), F.col("p_partkey").alias("ordinal"))


def fines(spark: SparkSession) -> DataFrame:
    """Fines sheet (parameter table)."""
    rows = [(o, v, Decimal(str(lf)), Decimal(str(sf)) if sf is not None else None) for o, v, lf, sf in FINES]
    return param_table(spark, rows,
                       "ordinal long, violation string, local_fine decimal(18,2), state_fine decimal(18,2)")


def params(spark: SparkSession) -> DataFrame:
    """One-row parameter sheet (collection rate)."""
    return param_table(spark, [(COLLECTION_RATE,)], "collection_rate double")


def prices(spark: SparkSession) -> DataFrame:
    """Model price list (parameter table)."""
    return param_table(spark, PRICES, "model string, prompt_price double, completion_price double")
