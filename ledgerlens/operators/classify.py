"""Agency filter (P1), prefix classifier (P2/P3, J3) and scope by prefix."""

from __future__ import annotations

from decimal import Decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as FV
from ..session import broadcast_checked, param_table, written_once

Rule = tuple[str, float, str, str]  # (prefix, revenue, violation_type, scope)

CLASS_TYPE = T.StructType([
    T.StructField("revenue", T.DecimalType(18, 2), True),
    T.StructField("violation_type", T.StringType(), True),
    T.StructField("scope", T.StringType(), True),
])


def agency_filter(df: DataFrame, agency: str = FV.FOCUS_AGENCY, column: str = "department") -> DataFrame:
    """Exact, case-sensitive equality; NULL department never matches.

    A plain equality on a scan column, so the predicate reaches the parquet
    reader (row-group skipping) and is pushed below any join by Catalyst.
    """
    return df.filter(F.col(column) == F.lit(agency))


def _class_struct(revenue, vtype, scope) -> Column:
    return F.struct(F.lit(Decimal(str(revenue))).cast("decimal(18,2)").alias("revenue"),
                    F.lit(vtype).alias("violation_type"), F.lit(scope).alias("scope"))


def classify_expr(code: Column, rules: Sequence[Rule] = FV.CITATION_RULES,
                  default: tuple[float, str, str] | None = FV.CITATION_DEFAULT) -> Column:
    """P2 as one CASE expression: first matching prefix wins, else ``default``.

    NULL codes give a NULL class (tested first, otherwise CASE would route
    them to the default). Stays inside whole-stage codegen; meant for rule
    lists of up to a few hundred entries (``classify_by_rules`` beyond).
    """
    expr = F.when(code.isNull(), F.lit(None).cast(CLASS_TYPE))
    for prefix, revenue, vtype, scope in rules:
        expr = expr.when(code.startswith(prefix), _class_struct(revenue, vtype, scope))
    fallback = _class_struct(*default) if default is not None else F.lit(None).cast(CLASS_TYPE)
    return expr.otherwise(fallback)


def classify_prefix(df: DataFrame, code_col: str = "violation_code",
                    rules: Sequence[Rule] = FV.CITATION_RULES,
                    default: tuple[float, str, str] | None = FV.CITATION_DEFAULT) -> DataFrame:
    """P2 + P3: add ``revenue``, ``violation_type`` and ``scope`` to every row (same row, no join)."""
    return (df.withColumn("_class", classify_expr(F.col(code_col), rules, default))
              .select("*", "_class.*").drop("_class"))


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rule list as a table ``(rule_order, prefix, revenue, violation_type, scope)``."""
    rows = [(i + 1, p, Decimal(str(r)), t, s) for i, (p, r, t, s) in enumerate(rules)]
    schema = "rule_order int, prefix string, revenue decimal(18,2), violation_type string, scope string"
    return param_table(spark, rows, schema)


def classify_by_rules(df: DataFrame, rules: DataFrame, code_col: str = "violation_code",
                      default: tuple[float, str, str] | None = FV.CITATION_DEFAULT) -> DataFrame:
    """First-match prefix lookup against a rule *table* of any size.

    Instead of a nested-loop join on ``startswith``, each distinct code is
    expanded into its own prefixes (bounded by the code length) and
    equi-joined to the rules on the prefix text; the lowest ``rule_order``
    wins per code. The empty prefix is one of them, so a catch-all rule matches
    every code. Only distinct codes take part; their classes are written once
    (one row per code) and broadcast to the rows when their measured size is
    small, so that the rows stay where they are. A larger class table is joined
    as the planner sees fit, with skewed codes split.
    """
    codes = df.select(F.col(code_col).alias("_code")).filter(F.col("_code").isNotNull()).distinct()
    # Prefixes longer than the longest rule can never match: cap the expansion there
    # (one scalar subquery over the rules).
    longest = rules.agg(F.max(F.length("prefix"))).scalar()
    bounded = codes.withColumn("_upto", F.least(F.length("_code"), F.coalesce(longest, F.lit(0))))
    prefixes = bounded.select(
        "_code",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("_upto")),
                              lambda n: F.substring(F.col("_code"), 1, n))).alias("_prefix"))
    matched = (prefixes.join(rules.withColumnRenamed("prefix", "_prefix"), "_prefix")
               .groupBy("_code")
               .agg(F.min_by(F.struct("revenue", "violation_type", "scope"), F.col("rule_order"))
                    .alias("_class")))
    fallback = _class_struct(*default) if default is not None else F.lit(None).cast(CLASS_TYPE)
    matched = written_once(matched, "classes")
    # a class row holds a code, a decimal and two labels: 64 bytes and the code's own length
    size = matched.agg(F.sum(F.length("_code") + F.lit(64))).first()[0] or 0
    joined = df.join(broadcast_checked(matched, size), F.col(code_col) == F.col("_code"), "left")
    cls = F.when(F.col(code_col).isNull(), F.lit(None).cast(CLASS_TYPE)).otherwise(
        F.coalesce(F.col("_class"), fallback))
    return joined.withColumn("_class", cls).select(*df.columns, "_class.*")


#: Rules that are looked up by range; their table goes to every task.
MAX_RANGE_RULES = 250_000


def _after(prefix: str) -> str | None:
    """The least text above all texts with this prefix, None if there is none."""
    for at in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[at])
        if code < 0x10FFFF:
            return prefix[:at] + chr(0xE000 if code == 0xD7FF else code + 1)
    return None


def prefix_ranges(rules: Sequence[Rule]) -> list[tuple[str, int]]:
    """The prefixes' trie laid out in text order: (least text, number of the first matching rule or -1) of each range.

    Texts of a prefix are one range; ranges nest. Between two neighbouring edges the same rules match, so the winner at
    an edge, found among its own prefixes, holds up to the next one. Neighbours of one winner are joined.
    """
    order: dict[str, int] = {}
    for i, rule in enumerate(rules):
        order.setdefault(rule[0], i)
    longest = max(map(len, order), default=0)
    edges = sorted({"", *order, *(e for e in map(_after, order) if e is not None)})
    out: list[tuple[str, int]] = []
    for edge in edges:
        found = [order[edge[:n]] for n in range(min(longest, len(edge)) + 1) if edge[:n] in order]
        winner = min(found, default=-1)
        if not out or out[-1][1] != winner:
            out.append((edge, winner))
    return out


def classify_by_ranges(df: DataFrame, rules: Sequence[Rule], code_col: str = "violation_code",
                       default: tuple[float, str, str] | None = FV.CITATION_DEFAULT) -> DataFrame:
    """J3 for a rule list of up to ``MAX_RANGE_RULES``: each row's code is looked up by binary search.

    The sorted ranges (see ``prefix_ranges``) are one array in a one-row table, a scalar subquery; a row costs as many
    comparisons as the number of ranges has bits. Rows stay where they are: no shuffle, no distinct, nothing written,
    and no job before the query runs. Texts are compared by code point.
    """
    if len(rules) > MAX_RANGE_RULES:
        raise ValueError(f"more than {MAX_RANGE_RULES} rules: use classify_by_rules with a table")
    ranges = prefix_ranges(rules)
    one = lambda r: (Decimal(str(r[1])), r[2], r[3])
    fallback = (Decimal(str(default[0])), *default[1:]) if default is not None else (None, None, None)
    rows = [(edge, *(one(rules[w]) if w >= 0 else fallback)) for edge, w in ranges]
    schema = "edge string, revenue decimal(18,2), violation_type string, scope string"
    table = df.sparkSession.createDataFrame(rows, schema).agg(F.array_sort(F.collect_list(F.struct(
        "edge", F.struct("revenue", "violation_type", "scope").alias("class")))).alias("t")).select(
        F.struct(F.col("t.edge").alias("edge"), F.col("t.class").alias("class"))).scalar()
    # the number of edges not above the code, built from its highest bit down; the first edge is the empty text
    bits = [1 << b for b in range(len(ranges).bit_length() - 1, -1, -1)]
    code = F.col("_looked_up")
    place = F.aggregate(F.array(*map(F.lit, bits)), F.lit(0), lambda at, bit: F.when(
        (at + bit <= F.lit(len(ranges))) & (F.get(F.col("_ranges.edge"), at + bit - 1) <= code), at + bit).otherwise(at))
    cls = F.when(code.isNotNull(), F.get(F.col("_ranges.class"), place - 1))
    return (df.withColumn("_ranges", table).withColumn("_looked_up", F.col(code_col)).withColumn("_class", cls)
            .select(*df.columns, "_class.*"))


def scope_of_ref(ref: Column, local_prefix: str = FV.LOCAL_CODE_PREFIX) -> Column:
    """``local`` when the code starts with the local prefix, else ``state``."""
    return F.when(ref.startswith(local_prefix), F.lit("local")).otherwise(F.lit("state"))
