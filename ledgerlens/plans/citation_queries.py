"""Registered queries of the citation revenue analysis."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as FV
from ..functions.text import int_from_text, month_year_title, parse_timestamp, period_months
from ..operators import classify as C
from ..operators import reports as R
from ..operators import violations as V
from ..operators.ordering import take_until_null
from ..session import scratch_path
from ..sources import files as FS
from ..sources.tables import SCHEMAS, read_csv_table, read_table
from . import standins as S
from .common import money_out


def _focus(spark: SparkSession, d: str) -> DataFrame:
    return C.agency_filter(S.citations(spark, d), S.FOCUS_AGENCY)


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return C.classify_prefix(_focus(spark, d), "violation_code", S.BRAND_RULES, S.BRAND_DEFAULT)


def scan_table(spark, d):
    """The orders sheet with its explicit schema."""
    return read_table(spark, d, "orders")


def agency_filter(spark, d):
    """Citations of the focus agency."""
    return _focus(spark, d)


def classify_prefix(spark, d):
    """P2 + P3: focus citations classified by the first matching code prefix (CASE chain)."""
    return money_out(_classified(spark, d).select(
        "l_orderkey", "l_linenumber", "violation_code", "revenue", "violation_type", "scope"))


def classify_rule_join(spark, d):
    """The same classification from a rule table (prefix equi-join on distinct codes)."""
    rules = C.rules_frame(spark, S.BRAND_RULES)
    out = C.classify_by_rules(_focus(spark, d), rules, "violation_code", S.BRAND_DEFAULT)
    return money_out(out.select("l_orderkey", "l_linenumber", "violation_code", "revenue",
                                "violation_type", "scope"))


def classify_rule_ranges(spark, d):
    """The same classification by a binary search of each code in the sorted ranges of the rules."""
    out = C.classify_by_ranges(_focus(spark, d), S.BRAND_RULES, "violation_code", S.BRAND_DEFAULT)
    return money_out(out.select("l_orderkey", "l_linenumber", "violation_code", "revenue", "violation_type", "scope"))


def citations_by_type_scope(spark, d):
    """A1 (flagship): focus citations counted by violation type, one column per scope."""
    return R.counts_by_type_scope(_classified(spark, d))


def revenue_by_type_scope(spark, d):
    """A2: focus citation revenue by violation type and scope."""
    return money_out(R.revenue_by_type_scope(_classified(spark, d)))


def month_revenue(spark, d):
    """P8 + P9 + A9: focus citation revenue by month and scope."""
    return money_out(R.month_revenue(_classified(spark, d)))


def months_spanned(spark, d):
    """Months covered by the focus citations, both ends included."""
    return R.months_spanned(_focus(spark, d))


def period_titles(spark, d) -> DataFrame:
    """A period title per department from its first and last order month."""
    o = read_table(spark, d, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("department"))
            .agg(month_year_title(F.min("o_orderdate"), F.max("o_orderdate")).alias("period_title")))


def period_months_q(spark, d):
    """months implied by each department's period title."""
    t = period_titles(spark, d)
    return t.select("department", "period_title", period_months(F.col("period_title")).alias("months"))


def violation_ref_merge(spark, d):
    """A5 + W1 + P5: one row per violation, last local/state code, first-appearance index."""
    return V.merge_violation_refs(S.violation_types(spark, d), local_prefix=S.LOCAL_PREFIX)


def membership_split(spark, d):
    """Incoming rows tagged update or insert against existing violation keys."""
    part = read_table(spark, d, "part").select(
        "p_partkey", "p_brand", F.concat_ws(" size ", "p_type", F.col("p_size").cast("string")).alias("violation"))
    existing = part.filter(F.col("p_brand").startswith(S.LOCAL_PREFIX))
    incoming = part.filter(~F.col("p_brand").startswith(S.LOCAL_PREFIX))
    return V.membership_split(incoming, existing, "violation").select(
        "p_partkey", "violation", F.col("p_brand").alias("ref"), "action")


def take_until_null_q(spark, d):
    """P5: customer rows in key order up to the first blank row."""
    # A deeply negative balance marks a blank row: the sheet ends at the first one.
    c = read_table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < -990, F.lit(None)).otherwise(F.col("c_name")).alias("ref"))
    return take_until_null(c, "ref", "c_custkey")


def _counted(spark, d) -> DataFrame:
    merged = V.merge_violation_refs(S.violation_types(spark, d), local_prefix=S.LOCAL_PREFIX)
    return V.exact_code_counts(merged, S.citations(spark, d), agency=S.FOCUS_AGENCY)


def exact_code_counts(spark, d):
    """J1 + A3: exact-code citation counts per violation, all and focus agency."""
    return _counted(spark, d).select("idx", "violation", "local_ref", "state_ref", "local_citations",
                                     "state_citations", "nopd_local_citations", "nopd_state_citations")


def positional_fine_join(spark, d):
    """The i-th violation takes fines row i."""
    merged = V.merge_violation_refs(S.violation_types(spark, d), local_prefix=S.LOCAL_PREFIX)
    return money_out(V.join_fines_positional(merged, S.fines(spark)).select(
        "idx", "violation", "local_fine", "state_fine"))


def _metrics(spark, d) -> DataFrame:
    return V.violation_metrics(V.join_fines_positional(_counted(spark, d), S.fines(spark)))


METRIC_COLUMNS = [
    "idx", "violation", "local_ref", "state_ref", "local_fine", "state_fine",
    "local_citations", "local_citation_revenue", "state_citations", "state_citation_revenue",
    "nopd_local_citations", "nopd_local_citation_revenue", "nopd_state_citations",
    "nopd_state_citation_revenue", "fine_difference", "total_citations", "total_revenue",
    "citation_difference", "total_difference_rev", "nopd_total_citations", "nopd_total_citation_revenue",
    "nopd_revenue_local_as_state", "nopd_total_revenue_local_as_state", "nopd_lost_revenue",
]


def violation_metrics(spark, d):
    """P10 + P11: revenues and the ten derived metrics per violation."""
    return money_out(_metrics(spark, d).select(*METRIC_COLUMNS))


def metrics_totals(spark, d):
    """A4: the thirteen grand totals."""
    return money_out(R.metrics_totals(_metrics(spark, d)))


def totals_long(spark, d):
    """The totals transposed to (type_of_total, value)."""
    return R.totals_long(R.metrics_totals(_metrics(spark, d)))


def citation_report(spark, d):
    """P6 + A6: citation report with a totals row."""
    return money_out(R.citation_report(_metrics(spark, d)))


def revenue_report(spark, d):
    """P6 + A6: revenue report with a totals row."""
    return money_out(R.revenue_report(_metrics(spark, d)))


def _impact(spark, d) -> DataFrame:
    totals = R.metrics_totals(_metrics(spark, d))
    months = period_months_q(spark, d).filter(F.col("department") == S.FOCUS_AGENCY).select("months")
    rate = S.params(spark).select("collection_rate")  # S10: a one-row parameter table
    # Each scalar is bound to a column once, so each subquery runs once.
    base = totals.select(F.col("sum_nopd_lost_revenue").cast("double").alias("sum_nopd_lost_revenue"),
                         months.scalar().alias("number_of_months"), rate.scalar().alias("_rate"))
    return base.select("sum_nopd_lost_revenue", "number_of_months",
                       *R.revenue_impact(F.col("sum_nopd_lost_revenue"), F.col("number_of_months"),
                                         F.col("_rate")))


def revenue_impact(spark, d):
    """S10 + J6 + P12: monthly, annualised and collection-rate impact."""
    return _impact(spark, d)


def impact_long(spark, d):
    """The impact figures as (Description, Value)."""
    return R.impact_long(_impact(spark, d))


def calc_trace(spark, d):
    """One formatted calculation line per step and violation."""
    return R.calc_trace(_metrics(spark, d))


def impact_trace(spark, d):
    """The lines from the lost revenue to its yearly impact."""
    return R.impact_trace(_impact(spark, d))


def classify_all_rules(spark, d):
    """P2 with the whole default rule list: codes that start with every prefix of it, and one that starts with none."""
    prefixes = [r[0] for r in FV.CITATION_RULES]
    n = len(prefixes) + 1
    at = (F.col("c_custkey") % n).cast("int")
    code = F.when(at == n - 1, F.col("c_mktsegment")).otherwise(
        F.concat(F.get(F.array(*map(F.lit, prefixes)), at), F.lit(" "), F.col("c_mktsegment")))
    coded = read_table(spark, d, "customer").select("c_custkey", code.alias("code"))
    return money_out(C.classify_prefix(coded, "code"))


def counts_in_order(spark, d):
    """Grouped counts sorted by their keys, as a grouping of the analysed application returns them."""
    counts = _classified(spark, d).groupBy("violation_type", "scope").agg(F.count(F.lit(1)).alias("n"))
    return R.in_order(counts, ["violation_type", "scope"])


def strict_dates(spark, d):
    """Order dates as text, parsed strictly; and with some spoilt, parsed leniently (bad ones NULL)."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    spoilt = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("on "), text)).otherwise(text)
    return read_table(spark, d, "orders").select(
        "o_orderkey", parse_timestamp(text, "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("parsed"),
        parse_timestamp(spoilt, "yyyy-MM-dd HH:mm:ss", strict=False).cast("timestamp_ntz").alias("lenient"))


def integers_from_text(spark, d):
    """part sizes written as padded text and read back as integers."""
    return read_table(spark, d, "part").select(
        "p_partkey", int_from_text(F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(" "))).alias("size"))


def fines_by_name(spark, d):
    """J2, safer form: fines matched on the violation name."""
    merged = V.merge_violation_refs(S.violation_types(spark, d), local_prefix=S.LOCAL_PREFIX)
    return money_out(V.join_fines_by_name(merged, S.fines(spark)).select("idx", "violation", "local_fine", "state_fine"))


def csv_sheet(spark, d):
    """S1 from CSV: the customer sheet written as CSV and scanned with its explicit schema."""
    path = scratch_path(spark, "customer_csv")
    read_table(spark, d, "customer").write.option("header", True).option("escape", '"').csv(path)
    return read_csv_table(spark, path, SCHEMAS["customer"])


def csv_quarantine(spark, d):
    """A customer sheet with spoilt lines; every line is a row or is kept as it stands.

    The sheet holds customers as CSV, some with a balance that is no number, some cut after two cells, some with a cell
    too many.
    """
    cust = read_table(spark, d, "customer")
    kind = F.col("c_custkey") % 10
    cells = [F.col(c).cast("string") for c in cust.columns]
    cells[3] = F.when(kind == 3, F.lit("n/a")).otherwise(cells[3])
    line = (F.when(kind == 7, F.concat_ws(",", *cells[:2])).when(kind == 9, F.concat_ws(",", *cells[:3], *cells[2:]))
            .otherwise(F.concat_ws(",", *cells)))
    path = scratch_path(spark, "spoilt_csv")
    cust.select(line.alias("value")).write.text(path)
    rows, spoilt = FS.read_csv_checked(spark, path, SCHEMAS["customer"], header=False)
    return rows.withColumn("spoilt_line", F.lit(None).cast("string")).unionByName(
        spoilt.select("spoilt_line"), allowMissingColumns=True)


def result_set(spark, d):
    """A set of result tables persisted by name, read back and counted; detail and totals in one pass."""
    base = scratch_path(spark, "results")
    paths = {name: f"{base}/{name}" for name in ("citations", "totals")}
    R.write_metrics(_metrics(spark, d), paths["citations"], paths["totals"])
    paths |= FS.write_results({"violations": V.merge_violation_refs(S.violation_types(spark, d),
                                                                    local_prefix=S.LOCAL_PREFIX)}, base)
    counts = [FS.read_current(spark, p).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, p in paths.items()]
    return functools.reduce(DataFrame.unionByName, counts)


def fill_missing(spark, d):
    """Empty balances filled with the nation average; existing values kept."""
    cust = read_table(spark, d, "customer")
    existing = cust.select("c_custkey", "c_nationkey", F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None))
                           .otherwise(F.col("c_acctbal")).alias("balance"))
    nation_avg = (cust.groupBy("c_nationkey")
                  .agg((F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double")
                        / F.count(F.lit(1)).cast("double")).alias("balance")))
    # Computed values are keyed by nation: one aggregate, joined back on the nation key.
    return V.fill_missing(existing, nation_avg, ["c_nationkey"], ["balance"]).select(
        "c_custkey", "c_nationkey", "balance")


QUERIES = {
    "scan_table": scan_table,
    "agency_filter": agency_filter,
    "classify_prefix": classify_prefix,
    "classify_rule_join": classify_rule_join,
    "classify_rule_ranges": classify_rule_ranges,
    "citations_by_type_scope": citations_by_type_scope,
    "revenue_by_type_scope": revenue_by_type_scope,
    "month_revenue": month_revenue,
    "months_spanned": months_spanned,
    "period_months": period_months_q,
    "violation_ref_merge": violation_ref_merge,
    "membership_split": membership_split,
    "take_until_null": take_until_null_q,
    "exact_code_counts": exact_code_counts,
    "positional_fine_join": positional_fine_join,
    "violation_metrics": violation_metrics,
    "metrics_totals": metrics_totals,
    "totals_long": totals_long,
    "citation_report": citation_report,
    "revenue_report": revenue_report,
    "revenue_impact": revenue_impact,
    "impact_long": impact_long,
    "calc_trace": calc_trace,
    "fill_missing": fill_missing,
    "impact_trace": impact_trace,
    "classify_all_rules": classify_all_rules,
    "counts_in_order": counts_in_order,
    "strict_dates": strict_dates,
    "integers_from_text": integers_from_text,
    "fines_by_name": fines_by_name,
    "csv_sheet": csv_sheet,
    "csv_quarantine": csv_quarantine,
    "result_set": result_set,
}
