"""DuckDB SQL equivalents of the citation queries (the correctness oracle)."""

from __future__ import annotations

from .. import fixed_values as FV
from ..operators.reports import FINE_GAP_SENTENCE, IMPACT_STEPS, TRACE_STEPS
from . import standins as S


def _dec(x) -> str:
    return "NULL" if x is None else f"CAST({x:.2f} AS DECIMAL(18,2))"


def _case(value_index: int) -> str:
    arms = " ".join(f"WHEN starts_with(violation_code, '{p}') THEN {_lit(r, value_index)}"
                    for p, *r in S.BRAND_RULES)
    return (f"CASE WHEN violation_code IS NULL THEN NULL {arms} "
            f"ELSE {_lit(list(S.BRAND_DEFAULT), value_index)} END")


def _lit(vals, i):
    v = vals[i]
    return _dec(v) if i == 0 else f"'{v}'"


CITATIONS = """citations AS (
  SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority AS department, p.p_brand AS violation_code,
         o.o_orderdate AS violation_date, l.l_extendedprice AS price
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""

FOCUS = f"""focus AS (SELECT * FROM citations WHERE department = '{S.FOCUS_AGENCY}')"""

CLASSIFIED = f"""classified AS (
  SELECT *, {_case(0)} AS revenue, {_case(1)} AS violation_type, {_case(2)} AS scope FROM focus)"""

BASE = f"WITH {CITATIONS},\n{FOCUS},\n{CLASSIFIED}"

MERGED = f"""vt AS (SELECT p_brand AS ref, p_type AS violation, p_partkey AS ordinal FROM part),
stop AS (SELECT min(ordinal) AS s FROM vt WHERE ref IS NULL),
vrows AS (
  SELECT violation, CAST(ref AS VARCHAR) AS ref, ordinal,
         CASE WHEN starts_with(ref, '{S.LOCAL_PREFIX}') THEN 'local' ELSE 'state' END AS scope
  FROM vt WHERE (SELECT s FROM stop) IS NULL OR ordinal < (SELECT s FROM stop)),
merged0 AS (
  SELECT violation,
         arg_max(ref, ordinal) FILTER (WHERE scope = 'local') AS local_ref,
         arg_max(ref, ordinal) FILTER (WHERE scope = 'state') AS state_ref,
         min(ordinal) AS first_ordinal
  FROM vrows GROUP BY violation),
merged AS (SELECT *, CAST(row_number() OVER (ORDER BY first_ordinal) - 1 AS BIGINT) AS idx FROM merged0)"""

FINES_VALUES = ", ".join(f"({o}, '{v}', {_dec(lf)}, {_dec(sf)})" for o, v, lf, sf in S.FINES)

COUNTED = f"""{CITATIONS},
{MERGED},
cc AS (SELECT violation_code AS code, count(*) AS n_all,
              count(*) FILTER (WHERE department = '{S.FOCUS_AGENCY}') AS n_focus
       FROM citations GROUP BY violation_code),
counted AS (
  SELECT m.*, CAST(coalesce(a.n_all, 0) AS BIGINT) AS local_citations,
         CAST(coalesce(b.n_all, 0) AS BIGINT) AS state_citations,
         CAST(coalesce(a.n_focus, 0) AS BIGINT) AS nopd_local_citations,
         CAST(coalesce(b.n_focus, 0) AS BIGINT) AS nopd_state_citations
  FROM merged m LEFT JOIN cc a ON m.local_ref = a.code LEFT JOIN cc b ON m.state_ref = b.code),
fines(ordinal, fviolation, local_fine, state_fine) AS (VALUES {FINES_VALUES}),
withfines AS (SELECT c.*, f.local_fine, f.state_fine FROM counted c LEFT JOIN fines f ON c.idx = f.ordinal),
rev AS (SELECT *, local_citations * local_fine AS local_citation_revenue,
               state_citations * state_fine AS state_citation_revenue,
               nopd_local_citations * local_fine AS nopd_local_citation_revenue,
               nopd_state_citations * state_fine AS nopd_state_citation_revenue FROM withfines),
metrics AS (
  SELECT *, state_fine - local_fine AS fine_difference,
         local_citations + state_citations AS total_citations,
         local_citation_revenue + state_citation_revenue AS total_revenue,
         local_citations - state_citations AS citation_difference,
         (local_citations - state_citations) * (state_fine - local_fine) AS total_difference_rev,
         nopd_local_citations + nopd_state_citations AS nopd_total_citations,
         nopd_local_citation_revenue + nopd_state_citation_revenue AS nopd_total_citation_revenue,
         nopd_local_citations * state_fine AS nopd_revenue_local_as_state,
         nopd_state_citation_revenue + nopd_local_citations * state_fine AS nopd_total_revenue_local_as_state,
         nopd_local_citations * state_fine - nopd_local_citation_revenue AS nopd_lost_revenue
  FROM rev)"""

MONEY = ["local_fine", "state_fine", "local_citation_revenue", "state_citation_revenue",
         "nopd_local_citation_revenue", "nopd_state_citation_revenue", "fine_difference", "total_revenue",
         "total_difference_rev", "nopd_total_citation_revenue", "nopd_revenue_local_as_state",
         "nopd_total_revenue_local_as_state", "nopd_lost_revenue"]
METRIC_SELECT = ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" if c in MONEY else c for c in [
        "idx", "violation", "local_ref", "state_ref", "local_fine", "state_fine",
        "local_citations", "local_citation_revenue", "state_citations", "state_citation_revenue",
        "nopd_local_citations", "nopd_local_citation_revenue", "nopd_state_citations",
        "nopd_state_citation_revenue", "fine_difference", "total_citations", "total_revenue",
        "citation_difference", "total_difference_rev", "nopd_total_citations", "nopd_total_citation_revenue",
        "nopd_revenue_local_as_state", "nopd_total_revenue_local_as_state", "nopd_lost_revenue"])

TOTAL_SOURCES = [
    "local_citations", "local_citation_revenue", "state_citations", "state_citation_revenue",
    "nopd_local_citations", "nopd_local_citation_revenue", "nopd_state_citations",
    "nopd_state_citation_revenue", "nopd_total_citations", "nopd_total_citation_revenue",
    "nopd_revenue_local_as_state", "nopd_total_revenue_local_as_state", "nopd_lost_revenue"]
TOTALS = "totals AS (SELECT " + ", ".join(
    f"CAST(sum({c}) AS {'DOUBLE' if c in MONEY else 'BIGINT'}) AS sum_{c}" for c in TOTAL_SOURCES) + " FROM metrics)"

PERIOD = """period AS (
  SELECT o_orderpriority AS department,
         strftime(min(o_orderdate), '%B %Y') || ' to ' || strftime(max(o_orderdate), '%B %Y') AS period_title,
         CAST(date_diff('month', date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate))) + 1 AS INTEGER) AS months
  FROM orders GROUP BY o_orderpriority)"""

IMPACT = f"""{PERIOD},
impact AS (
  SELECT sum_nopd_lost_revenue,
         (SELECT months FROM period WHERE department = '{S.FOCUS_AGENCY}') AS number_of_months
  FROM totals),
impact2 AS (
  SELECT sum_nopd_lost_revenue, number_of_months,
         sum_nopd_lost_revenue / NULLIF(CAST(number_of_months AS DOUBLE), 0) AS average_monthly_revenue_lost,
         sum_nopd_lost_revenue / NULLIF(CAST(number_of_months AS DOUBLE) / 12.0, 0) AS annualized_lost_revenue,
         CAST({S.COLLECTION_RATE} AS DOUBLE) AS collection_rate
  FROM impact),
impact3 AS (SELECT *, annualized_lost_revenue * collection_rate AS estimated_annual_revenue_impact FROM impact2)"""


def _report(cols: dict[str, str], label: str) -> str:
    value_cols = [c for c in cols if c != "violation"]
    casted = lambda c: f"CAST(sum({c}) AS {'DOUBLE' if c in MONEY else 'BIGINT'})"
    detail = ", ".join(f"{casted(c)} AS \"{cols[c]}\"" for c in value_cols)
    return (f"WITH {COUNTED}\n"
            f"SELECT min(idx) AS line, violation AS \"Violation\", {detail} FROM metrics GROUP BY violation\n"
            f"UNION ALL SELECT CAST(NULL AS BIGINT), '{label}', {detail} FROM metrics")


def _term(name: str) -> str:
    if name == "months in a year":
        return "'12'"
    fmt, name = ("%d", name[1:]) if name.startswith("#") else ("%.2f", name)
    return f"coalesce(printf('{fmt}', {name}), 'n/a')"


def _lines(steps, cte: str, keys: str, first: int = 0, before=(), after=()) -> str:
    lines = [*before, *(f"'{label}: ' || {_term(x)} || ' {op} ' || {_term(y)} || ' = ' || {_term(z)}"
                        for label, x, op, y, z in steps), *after]
    return " UNION ALL ".join(f"SELECT {keys}CAST({i + first} AS INTEGER) AS step, {line} AS line FROM {cte}"
                              for i, line in enumerate(lines))


def _trace() -> str:
    arms = _lines(TRACE_STEPS, "metrics", "idx, violation, ", before=["'violation ' || coalesce(violation, 'n/a')"],
                  after=[f"'{FINE_GAP_SENTENCE}' || {_term('fine_difference')}"])
    return f"WITH {COUNTED}\n{arms}"


def _all_rules() -> str:
    """The default rule list over codes made of each customer's balance and segment."""
    def arm(i):
        hits = " ".join(f"WHEN starts_with(code, '{r[0]}') THEN {_lit(r[1:], i)}" for r in FV.CITATION_RULES)
        return f"CASE WHEN code IS NULL THEN NULL {hits} ELSE {_lit(FV.CITATION_DEFAULT, i)} END"
    prefixes = ", ".join(f"'{r[0]}'" for r in FV.CITATION_RULES)
    n = len(FV.CITATION_RULES) + 1
    return (f"WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % {n} = {n - 1} THEN c_mktsegment "
            f"ELSE [{prefixes}][CAST(c_custkey % {n} AS INTEGER) + 1] || ' ' || c_mktsegment END AS code FROM customer)\n"
            f"SELECT c_custkey, code, CAST({arm(0)} AS DOUBLE) AS revenue, {arm(1)} AS violation_type, {arm(2)} AS scope FROM c")


SQL = {
    "scan_table": "SELECT * FROM orders",
    "agency_filter": f"WITH {CITATIONS},\n{FOCUS}\nSELECT * FROM focus",
    "classify_prefix": f"{BASE}\nSELECT l_orderkey, l_linenumber, violation_code, CAST(revenue AS DOUBLE) AS revenue, "
                       "violation_type, scope FROM classified",
    "classify_rule_join": f"{BASE}\nSELECT l_orderkey, l_linenumber, violation_code, CAST(revenue AS DOUBLE) AS revenue, "
                          "violation_type, scope FROM classified",
    "classify_rule_ranges": f"{BASE}\nSELECT l_orderkey, l_linenumber, violation_code, CAST(revenue AS DOUBLE) AS revenue, "
                          "violation_type, scope FROM classified",
    "citations_by_type_scope": f"{BASE}\nSELECT violation_type, "
                               "NULLIF(count(*) FILTER (WHERE scope = 'local'), 0) AS local, "
                               "NULLIF(count(*) FILTER (WHERE scope = 'state'), 0) AS state "
                               "FROM classified WHERE violation_type IS NOT NULL AND scope IS NOT NULL GROUP BY violation_type",
    "revenue_by_type_scope": f"{BASE}\nSELECT violation_type, "
                             "CAST(sum(revenue) FILTER (WHERE scope = 'local') AS DOUBLE) AS local, "
                             "CAST(sum(revenue) FILTER (WHERE scope = 'state') AS DOUBLE) AS state "
                             "FROM classified WHERE violation_type IS NOT NULL AND scope IS NOT NULL GROUP BY violation_type",
    "month_revenue": f"{BASE}\nSELECT strftime(violation_date, '%Y-%m') AS month, "
                     "CAST(sum(revenue) FILTER (WHERE scope = 'local') AS DOUBLE) AS local, "
                     "CAST(sum(revenue) FILTER (WHERE scope = 'state') AS DOUBLE) AS state "
                     "FROM classified WHERE violation_date IS NOT NULL AND scope IS NOT NULL GROUP BY 1",
    "months_spanned": f"WITH {CITATIONS},\n{FOCUS}\nSELECT CAST(date_diff('month', date_trunc('month', min(violation_date)), "
                      "date_trunc('month', max(violation_date))) + 1 AS INTEGER) AS months FROM focus",
    "period_months": f"WITH {PERIOD}\nSELECT department, period_title, months FROM period",
    "violation_ref_merge": f"WITH {MERGED}\nSELECT violation, local_ref, state_ref, first_ordinal, idx FROM merged",
    "membership_split": f"""WITH p AS (SELECT p_partkey, p_brand, p_type || ' size ' || CAST(p_size AS VARCHAR) AS violation FROM part),
existing AS (SELECT DISTINCT violation FROM p WHERE starts_with(p_brand, '{S.LOCAL_PREFIX}'))
SELECT p_partkey, violation, p_brand AS ref,
       CASE WHEN violation IN (SELECT violation FROM existing) THEN 'update' ELSE 'insert' END AS action
FROM p WHERE NOT starts_with(p_brand, '{S.LOCAL_PREFIX}')""",
    "take_until_null": """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < -990 THEN NULL ELSE c_name END AS ref FROM customer)
SELECT * FROM c WHERE (SELECT min(c_custkey) FROM c WHERE ref IS NULL) IS NULL
   OR c_custkey < (SELECT min(c_custkey) FROM c WHERE ref IS NULL)""",
    "exact_code_counts": f"WITH {COUNTED}\nSELECT idx, violation, local_ref, state_ref, local_citations, state_citations, "
                         "nopd_local_citations, nopd_state_citations FROM counted",
    "positional_fine_join": f"WITH {COUNTED}\nSELECT idx, violation, CAST(local_fine AS DOUBLE) AS local_fine, "
                            "CAST(state_fine AS DOUBLE) AS state_fine FROM withfines",
    "violation_metrics": f"WITH {COUNTED}\nSELECT {METRIC_SELECT} FROM metrics",
    "metrics_totals": f"WITH {COUNTED},\n{TOTALS}\nSELECT * FROM totals",
    "totals_long": f"WITH {COUNTED},\n{TOTALS}\nSELECT type_of_total, CAST(value AS DOUBLE) AS value FROM "
                   "(UNPIVOT totals ON COLUMNS(*) INTO NAME type_of_total VALUE value)",
    "citation_report": _report({"violation": "Violation", "nopd_local_citations": "NOPD Local Citations",
                                "nopd_state_citations": "NOPD State Citations",
                                "nopd_total_citations": "NOPD Total Citations"}, "Total NOPD Citations"),
    "revenue_report": _report({"violation": "Violation", "nopd_local_citation_revenue": "NOPD Local Revenue",
                               "nopd_state_citation_revenue": "NOPD State Revenue",
                               "nopd_total_citation_revenue": "NOPD Total Revenue",
                               "nopd_revenue_local_as_state": "NOPD Revenue Local as State",
                               "nopd_total_revenue_local_as_state": "Total NOPD Revenue Local as State",
                               "nopd_lost_revenue": "NOPD Lost Revenue"}, "Total NOPD Revenue"),
    "revenue_impact": f"WITH {COUNTED},\n{TOTALS},\n{IMPACT}\nSELECT * FROM impact3",
    "impact_long": f"WITH {COUNTED},\n{TOTALS},\n{IMPACT}\n"
                   "SELECT 'Average Monthly Lost Revenue' AS \"Description\", average_monthly_revenue_lost AS \"Value\" FROM impact3 "
                   "UNION ALL SELECT 'Annualized Lost Revenue', annualized_lost_revenue FROM impact3 "
                   "UNION ALL SELECT 'Collection Rate', collection_rate FROM impact3 "
                   "UNION ALL SELECT 'Estimated Annual Revenue Impact', estimated_annual_revenue_impact FROM impact3",
    "calc_trace": _trace(),
    "impact_trace": f"WITH {COUNTED},\n{TOTALS},\n{IMPACT}\n{_lines(IMPACT_STEPS, 'impact3', '')}",
    "classify_all_rules": _all_rules(),
    "counts_in_order": f"{BASE},\ng AS (SELECT violation_type, scope, count(*) AS n FROM classified GROUP BY 1, 2)\n"
                       "SELECT violation_type, scope, n, row_number() OVER (ORDER BY violation_type NULLS FIRST, "
                       "scope NULLS FIRST) AS line FROM g",
    "strict_dates": "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS parsed, "
                    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS lenient FROM orders",
    "integers_from_text": "SELECT p_partkey, p_size AS size FROM part",
    "fines_by_name": f"WITH {COUNTED}\nSELECT idx, m.violation, CAST(f.local_fine AS DOUBLE) AS local_fine, "
                     "CAST(f.state_fine AS DOUBLE) AS state_fine FROM merged m LEFT JOIN fines f ON m.violation = f.fviolation",
    "csv_sheet": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "csv_quarantine": """SELECT CASE WHEN good THEN c_custkey END AS c_custkey, CASE WHEN good THEN c_name END AS c_name,
       CASE WHEN good THEN c_nationkey END AS c_nationkey, CASE WHEN good THEN c_acctbal END AS c_acctbal,
       CASE WHEN good THEN c_mktsegment END AS c_mktsegment,
       CASE c_custkey % 10
         WHEN 3 THEN concat_ws(',', c_custkey, c_name, c_nationkey, 'n/a', c_mktsegment)
         WHEN 7 THEN concat_ws(',', c_custkey, c_name)
         WHEN 9 THEN concat_ws(',', c_custkey, c_name, c_nationkey, c_nationkey, c_acctbal, c_mktsegment) END AS spoilt_line
FROM (SELECT *, c_custkey % 10 NOT IN (3, 7, 9) AS good FROM customer)""",
    "result_set": f"WITH {COUNTED},\n{TOTALS}\nSELECT 'citations' AS name, count(*) AS n FROM metrics "
                  "UNION ALL SELECT 'totals', count(*) FROM totals "
                  "UNION ALL SELECT 'violations', count(*) FROM merged",
    "fill_missing": """WITH e AS (SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS balance FROM customer),
na AS (SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS balance FROM customer GROUP BY c_nationkey)
SELECT e.c_custkey, e.c_nationkey, coalesce(e.balance, na.balance) AS balance FROM e LEFT JOIN na ON e.c_nationkey = na.c_nationkey""",
}
