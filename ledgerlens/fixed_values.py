"""Fixed values that must equal the analysed application's for equal results.

FIXED VALUES — kept verbatim, in their natural order. Nothing in this module is
logic; operators read these as parameters and every one can be overridden.
"""

# --- FIXED VALUES: citation classifier, first matching prefix wins -------------
# (code prefix, fine, violation type, scope), in evaluation order.
CITATION_RULES = [
    ("154:383", 257.50, "Careless operation of a vehicle", "local"),
    ("32:58", 302.50, "Careless operation of a vehicle", "state"),
    ("154:303", 207.50, "D/L not on person", "local"),
    ("32:411.1", 302.50, "D/L not on person", "state"),
    ("154:236", 227.50, "Disregard red light", "local"),
    ("32:232", 302.50, "Disregard red light", "state"),
    ("154:400", 207.50, "Drivers to use reasonable vigilance", "local"),
    ("154:401", 227.50, "Following too closely", "local"),
    ("32:81", 302.50, "Following too closely", "state"),
    ("154:240", 157.50, "Improper lane use", "local"),
    ("32:79", 302.50, "Improper lane use", "state"),
    ("154:436", 157.50, "Improper turn", "local"),
    ("32:101", 302.50, "Improper turn", "state"),
    ("154:307", 157.50, "License plates", "local"),
    ("32:53A", 302.50, "License plates", "state"),
    ("154:1298", 207.50, "No/expired brake tag", "local"),
    ("32:53D", 302.50, "No/expired brake tag", "state"),
    ("154:304", 607.50, "Unlawful use of license", "local"),
    ("32:414.1", 627.50, "Unlawful use of license", "state"),
    ("154:482", 227.50, "Yield right of way", "local"),
]
# Returned when no prefix matches.
CITATION_DEFAULT = (302.50, "Yield right of way", "state")

# --- FIXED VALUES: agency focus and local-code marker ---------------------------
FOCUS_AGENCY = "01 - CITY POLICE"
LOCAL_CODE_PREFIX = "154"
SUMMARY_ROW_OFFSET = 3  # first violation row of the fines sheet (row index + 3)

# --- FIXED VALUES: model prices in dollars per 1,000 tokens ---------------------
ANSWER_PROMPT_PRICE_PER_1K = 0.01
ANSWER_COMPLETION_PRICE_PER_1K = 0.03
RETRIEVAL_PROMPT_PRICE_PER_1K = 0.0005
RETRIEVAL_COMPLETION_PRICE_PER_1K = 0.0015

# --- FIXED VALUES: retrieval defaults --------------------------------------------
DEFAULT_TOP_N = 100
DEFAULT_TOKEN_BUDGET = 2000
SUMMARY_TOKEN_TARGET = 500
REPORT_TOP_N = 3

# --- FIXED VALUES: file routing by extension (case-sensitive suffix test) -------
ANALYSE_EXTENSIONS = (".xlsx", ".xls")
STORE_EXTENSIONS = (".doc", ".docx")

# --- FIXED VALUES: result-table labels --------------------------------------------
TOTAL_COLUMNS = [
    "sum_local_citations", "sum_local_citation_revenue",
    "sum_state_citations", "sum_state_citation_revenue",
    "sum_nopd_local_citations", "sum_nopd_local_citation_revenue",
    "sum_nopd_state_citations", "sum_nopd_state_citation_revenue",
    "sum_nopd_total_citations", "sum_nopd_total_citation_revenue",
    "sum_nopd_revenue_local_as_state",
    "sum_nopd_total_revenue_local_as_state", "sum_nopd_lost_revenue",
]
IMPACT_DESCRIPTIONS = [
    "Average Monthly Lost Revenue", "Annualized Lost Revenue", "Collection Rate",
    "Estimated Annual Revenue Impact",
]
CITATION_REPORT_COLUMNS = {
    "violation": "Violation",
    "nopd_local_citations": "NOPD Local Citations",
    "nopd_state_citations": "NOPD State Citations",
    "nopd_total_citations": "NOPD Total Citations",
}
CITATION_TOTAL_LABEL = "Total NOPD Citations"
REVENUE_REPORT_COLUMNS = {
    "violation": "Violation",
    "nopd_local_citation_revenue": "NOPD Local Revenue",
    "nopd_state_citation_revenue": "NOPD State Revenue",
    "nopd_total_citation_revenue": "NOPD Total Revenue",
    "nopd_revenue_local_as_state": "NOPD Revenue Local as State",
    "nopd_total_revenue_local_as_state": "Total NOPD Revenue Local as State",
    "nopd_lost_revenue": "NOPD Lost Revenue",
}
REVENUE_TOTAL_LABEL = "Total NOPD Revenue"
