"""Chart-ready pivots (A1, A2, A9), span (A8), totals (A4, A6, A7), report tables (P6),
impact (P12, P13) and the calculation trace (P14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import fixed_values as FV
from ..sources.versions import publish, publish_with_totals

SCOPES = ["local", "state"]


def _by_scope(df: DataFrame, keys: list[Column], value: Column | None, scopes: list[str]) -> DataFrame:
    """Pivot on ``scope`` as conditional aggregates: one hash aggregate, one exchange.

    (``groupBy().pivot()`` plans two aggregations and two exchanges.) An absent
    (key, scope) combination is NULL, as in a pivot: a count of 0 becomes NULL
    and a sum over no rows is NULL already. Rows with a NULL key or scope are
    left out, as a grouped count over (key, scope) leaves them out.
    """
    df = df.filter(F.col("scope").isNotNull())
    for k in keys:
        df = df.filter(k.isNotNull())
    aggs = []
    for s in scopes:
        hit = F.col("scope") == F.lit(s)
        if value is None:
            aggs.append(F.nullif(F.count(F.when(hit, F.lit(1))), F.lit(0)).alias(s))
        else:
            aggs.append(F.sum(F.when(hit, value)).alias(s))
    return df.groupBy(*keys).agg(*aggs)


def counts_by_type_scope(classified: DataFrame, scopes: list[str] = SCOPES) -> DataFrame:
    """A1: citations per violation type, one column per scope, NULL where absent."""
    return _by_scope(classified, [F.col("violation_type")], None, scopes)


def revenue_by_type_scope(classified: DataFrame, scopes: list[str] = SCOPES) -> DataFrame:
    """A2: revenue per violation type and scope (exact decimal sums)."""
    return _by_scope(classified, [F.col("violation_type")], F.col("revenue"), scopes)


def month_revenue(classified: DataFrame, date_col: str = "violation_date",
                  scopes: list[str] = SCOPES) -> DataFrame:
    """P8 + P9 + A9: monthly (``yyyy-MM``) revenue by scope."""
    return _by_scope(classified, [F.date_format(F.col(date_col), "yyyy-MM").alias("month")],
                     F.col("revenue"), scopes)


def months_spanned(df: DataFrame, date_col: str = "violation_date") -> DataFrame:
    """Months covered by the dates, both end months included."""
    return df.agg((F.months_between(F.trunc(F.max(date_col), "MM"), F.trunc(F.min(date_col), "MM"))
                   .cast("int") + 1).alias("months"))


def total_columns() -> list[Column]:
    """The thirteen grand totals as aggregates of the metric columns, each under its own name."""
    return [F.sum(name[len("sum_"):]).alias(name) for name in FV.TOTAL_COLUMNS]


def metrics_totals(metrics: DataFrame) -> DataFrame:
    """A4: the thirteen grand totals in one aggregate."""
    return metrics.agg(*total_columns())


def write_metrics(metrics: DataFrame, path: str, totals_path: str) -> None:
    """A4 + A6 + S9: the detail rows and their thirteen totals as two tables, the metrics being computed once.

    The totals are taken while the detail is written (see ``sources.versions.publish_with_totals``).
    """
    publish(publish_with_totals(metrics, path, total_columns()), totals_path)


def totals_long(totals: DataFrame) -> DataFrame:
    """Transpose the one-row totals into (type_of_total, value)."""
    cols = [F.col(c).cast("double").alias(c) for c in FV.TOTAL_COLUMNS]
    return totals.select(*cols).unpivot([], FV.TOTAL_COLUMNS, "type_of_total", "value")


def _report(metrics: DataFrame, columns: dict[str, str], total_label: str) -> DataFrame:
    """P6 + A6: detail rows per violation plus a totals row, via ``rollup``."""
    value_cols = [c for c in columns if c != "violation"]
    agg = metrics.rollup("violation").agg(
        *[F.sum(c).alias(c) for c in value_cols], F.min("idx").alias("_idx"),
        F.grouping("violation").alias("_total"))
    label = F.when(F.col("_total") == 1, F.lit(total_label)).otherwise(F.col("violation"))
    return agg.select(
        F.when(F.col("_total") == 1, F.lit(None).cast("long")).otherwise(F.col("_idx")).alias("line"),
        label.alias(columns["violation"]),
        *[F.col(c).alias(columns[c]) for c in value_cols])


def citation_report(metrics: DataFrame) -> DataFrame:
    """Citation counts per violation plus a totals row."""
    return _report(metrics, FV.CITATION_REPORT_COLUMNS, FV.CITATION_TOTAL_LABEL)


def revenue_report(metrics: DataFrame) -> DataFrame:
    """Revenue figures per violation plus a totals row."""
    return _report(metrics, FV.REVENUE_REPORT_COLUMNS, FV.REVENUE_TOTAL_LABEL)


def revenue_impact(lost_revenue: Column, months: Column, collection_rate: Column) -> list[Column]:
    """Monthly average, annualised loss and the collection-rate impact.

    Zero months gives NULL instead of a division error.
    """
    lost = lost_revenue.cast("double")
    m = months.cast("double")
    monthly = F.try_divide(lost, m)
    annual = F.try_divide(lost, F.try_divide(m, F.lit(12.0)))
    return [monthly.alias("average_monthly_revenue_lost"),
            annual.alias("annualized_lost_revenue"),
            collection_rate.cast("double").alias("collection_rate"),
            (annual * collection_rate.cast("double")).alias("estimated_annual_revenue_impact")]


def impact_long(impact: DataFrame) -> DataFrame:
    """(Description, Value) rows of the impact figures."""
    cols = ["average_monthly_revenue_lost", "annualized_lost_revenue", "collection_rate",
            "estimated_annual_revenue_impact"]
    renamed = impact.select(*[F.col(c).alias(d) for c, d in zip(cols, FV.IMPACT_DESCRIPTIONS)])
    return renamed.unpivot([], FV.IMPACT_DESCRIPTIONS, "Description", "Value")


def _num(c: Column, fmt: str) -> Column:
    # Money is decimal inside; ``%f`` needs a double (two-decimal values format identically).
    v = c.cast("double") if fmt.endswith("f") else c
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.format_string(fmt, v))


def _line(label: str, first: Column, op: str, second: Column, result: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), first, F.lit(f" {op} "), second, F.lit(" = "), result)


#: Steps of the trace: (label, first term, operator, second term, result); a leading ``#`` marks a count.
TRACE_STEPS = [
    ("fine gap between scopes", "state_fine", "-", "local_fine", "fine_difference"),
    ("citations of both scopes", "#local_citations", "+", "#state_citations", "#total_citations"),
    ("revenue of both scopes", "local_citation_revenue", "+", "state_citation_revenue", "total_revenue"),
    ("surplus of local over state citations", "#local_citations", "-", "#state_citations", "#citation_difference"),
    ("surplus priced at the fine gap", "#citation_difference", "*", "fine_difference", "total_difference_rev"),
    ("agency citations", "#nopd_local_citations", "+", "#nopd_state_citations", "#nopd_total_citations"),
    ("agency revenue", "nopd_local_citation_revenue", "+", "nopd_state_citation_revenue",
     "nopd_total_citation_revenue"),
    ("agency local citations at state fines", "#nopd_local_citations", "*", "state_fine", "nopd_revenue_local_as_state"),
    ("agency revenue had all been state", "nopd_state_citation_revenue", "+", "nopd_revenue_local_as_state",
     "nopd_total_revenue_local_as_state"),
    ("agency revenue forgone", "nopd_revenue_local_as_state", "-", "nopd_local_citation_revenue", "nopd_lost_revenue"),
]
FINE_GAP_SENTENCE = "a state fine exceeds the local one by "
IMPACT_STEPS = [
    ("monthly average", "sum_nopd_lost_revenue", "/", "#number_of_months", "average_monthly_revenue_lost"),
    ("per year", "average_monthly_revenue_lost", "*", "months in a year", "annualized_lost_revenue"),
    ("at the collection rate", "annualized_lost_revenue", "*", "collection_rate", "estimated_annual_revenue_impact"),
]


def _term(name: str) -> Column:
    if name == "months in a year":
        return F.lit("12")
    return _num(F.col(name[1:]), "%d") if name.startswith("#") else _num(F.col(name), "%.2f")


def calc_trace(metrics: DataFrame) -> DataFrame:
    """One human-readable line per derived step and violation (step 0 names it, the last says the fine gap)."""
    steps = [F.concat(F.lit("violation "), F.coalesce("violation", F.lit("n/a"))),
             *(_line(label, _term(x), op, _term(y), _term(z)) for label, x, op, y, z in TRACE_STEPS),
             F.concat(F.lit(FINE_GAP_SENTENCE), _term("fine_difference"))]
    return metrics.select("idx", "violation", F.posexplode(F.array(*steps)).alias("step", "line"))


def impact_trace(impact: DataFrame) -> DataFrame:
    """P14, second half: one line per step from the lost revenue to its yearly impact."""
    steps = [_line(label, _term(x), op, _term(y), _term(z)) for label, x, op, y, z in IMPACT_STEPS]
    return impact.select(F.posexplode(F.array(*steps)).alias("step", "line"))


def in_order(df: DataFrame, keys: list[str], number: str = "line") -> DataFrame:
    """A grouped result in the order of its group keys, NULLs first, with the row's place in it.

    The result of a grouping is meant (a few rows per group); the place makes the order part of the data.
    """
    place = F.row_number().over(Window.orderBy(*[F.col(k).asc_nulls_first() for k in keys]))
    return df.withColumn(number, place.cast("long")).orderBy(number)
