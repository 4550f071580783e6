"""Per-violation pipeline: reference merge (A5, W1, P5), exact-code counts (J1, A3),
fines join (J2), derived metrics (P10, P11), fill-if-empty (S11), membership (J5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as FV
from .classify import scope_of_ref
from .ordering import dense_index, take_until_null


def merge_violation_refs(violation_types: DataFrame, ref: str = "ref", violation: str = "violation",
                         ordinal: str = "ordinal", local_prefix: str = FV.LOCAL_CODE_PREFIX) -> DataFrame:
    """A5 + W1 + P5: one row per violation with its last local and last state code.

    Rows after the first NULL code are ignored (P5). The last row (highest
    ordinal) per (violation, scope) wins, and ``idx`` numbers violations in
    order of first appearance (W1). ``max_by``/``min`` combine map-side, so a
    violation holding a third of the rows costs no more than any other.
    """
    rows = take_until_null(violation_types, ref, ordinal).select(
        F.col(violation).alias("violation"), F.col(ref).cast("string").alias("_ref"),
        F.col(ordinal).alias("_ord"))
    rows = rows.withColumn("_scope", scope_of_ref(F.col("_ref"), local_prefix))
    merged = rows.groupBy("violation").agg(
        F.max_by("_ref", F.when(F.col("_scope") == "local", F.col("_ord"))).alias("local_ref"),
        F.max_by("_ref", F.when(F.col("_scope") == "state", F.col("_ord"))).alias("state_ref"),
        F.min("_ord").alias("first_ordinal"))
    return dense_index(merged, ["first_ordinal"], name="idx")


def code_counts(citations: DataFrame, code: str = "violation_code", department: str = "department",
                agency: str = FV.FOCUS_AGENCY) -> DataFrame:
    """A3 for every code at once: all rows and the focus agency's rows, one scan."""
    return (citations.groupBy(F.col(code).alias("_code"))
            .agg(F.count(F.lit(1)).alias("_n_all"),
                 F.count_if(F.col(department) == F.lit(agency)).alias("_n_focus")))


def exact_code_counts(violations: DataFrame, citations: DataFrame, code: str = "violation_code",
                      department: str = "department", agency: str = FV.FOCUS_AGENCY) -> DataFrame:
    """Exact-match citation counts for each violation's local and state code.

    Aggregate-then-join: the citations are scanned and aggregated once (not
    four times per violation). Each violation's two codes become (scope, ref)
    rows, so one equi-join against the per-code counts serves both, and the
    small violation table folds back to one row per violation. Counting combines
    map-side, one row per code and task, so codes that no violation names cost
    nothing worth a join of the citations. A code shared
    by two violations counts fully for both; a NULL or unseen code counts 0.
    """
    refs = violations.select(
        "*", F.explode(F.array(F.struct(F.lit("local").alias("_scope"), F.col("local_ref").alias("_ref")),
                               F.struct(F.lit("state").alias("_scope"), F.col("state_ref").alias("_ref"))))
        .alias("_r")).select("*", "_r._scope", "_r._ref").drop("_r")
    counts = code_counts(citations, code, department, agency)
    joined = refs.join(counts, F.col("_ref") == F.col("_code"), "left")
    local, state = F.col("_scope") == "local", F.col("_scope") == "state"
    return joined.groupBy(*violations.columns).agg(
        F.coalesce(F.max(F.when(local, F.col("_n_all"))), F.lit(0)).alias("local_citations"),
        F.coalesce(F.max(F.when(state, F.col("_n_all"))), F.lit(0)).alias("state_citations"),
        F.coalesce(F.max(F.when(local, F.col("_n_focus"))), F.lit(0)).alias("nopd_local_citations"),
        F.coalesce(F.max(F.when(state, F.col("_n_focus"))), F.lit(0)).alias("nopd_state_citations"))


def join_fines_positional(violations: DataFrame, fines: DataFrame, index: str = "idx",
                          fine_ordinal: str = "ordinal") -> DataFrame:
    """The i-th violation takes the fines on fines row i (positional, as in the sheet)."""
    f = fines.select(F.col(fine_ordinal).alias("_fo"), "local_fine", "state_fine")
    return violations.join(f, F.col(index) == F.col("_fo"), "left").drop("_fo")


def join_fines_by_name(violations: DataFrame, fines: DataFrame) -> DataFrame:
    """J2, safer form: fines matched on the violation name."""
    f = fines.select(F.col("violation").alias("_fv"), "local_fine", "state_fine")
    return violations.join(f, F.col("violation").eqNullSafe(F.col("_fv")), "left").drop("_fv")


def violation_metrics(df: DataFrame) -> DataFrame:
    """P10 + P11: revenues (count x fine) and the ten derived per-violation metrics.

    Money stays ``decimal`` so sums are exact and order-independent; a NULL
    fine gives NULL revenue and NULL dependent metrics.
    """
    c = F.col
    out = df.withColumns({
        "local_citation_revenue": c("local_citations") * c("local_fine"),
        "state_citation_revenue": c("state_citations") * c("state_fine"),
        "nopd_local_citation_revenue": c("nopd_local_citations") * c("local_fine"),
        "nopd_state_citation_revenue": c("nopd_state_citations") * c("state_fine"),
    })
    return out.withColumns({
        "fine_difference": c("state_fine") - c("local_fine"),
        "total_citations": c("local_citations") + c("state_citations"),
        "total_revenue": c("local_citation_revenue") + c("state_citation_revenue"),
        "citation_difference": c("local_citations") - c("state_citations"),
        "total_difference_rev": (c("local_citations") - c("state_citations"))
        * (c("state_fine") - c("local_fine")),
        "nopd_total_citations": c("nopd_local_citations") + c("nopd_state_citations"),
        "nopd_total_citation_revenue": c("nopd_local_citation_revenue") + c("nopd_state_citation_revenue"),
        "nopd_revenue_local_as_state": c("nopd_local_citations") * c("state_fine"),
        "nopd_total_revenue_local_as_state": c("nopd_state_citation_revenue")
        + c("nopd_local_citations") * c("state_fine"),
        "nopd_lost_revenue": c("nopd_local_citations") * c("state_fine") - c("nopd_local_citation_revenue"),
    })


def fill_missing(existing: DataFrame, computed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Write computed values only into empty cells; existing values are kept."""
    comp = computed.select(*keys, *[F.col(x).alias(f"_new_{x}") for x in columns])
    joined = existing.join(comp, keys, "left")
    return joined.select(*[F.col(x) for x in existing.columns if x not in columns],
                         *[F.coalesce(F.col(x), F.col(f"_new_{x}")).alias(x) for x in columns])


def membership_split(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Tag each incoming row ``update`` if its key is already present, else ``insert``.

    The existing side is reduced to distinct keys (map-side), then one left
    join; NULL keys never match, so they are inserts.
    """
    keys = existing.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return (incoming.join(keys, F.col(key) == F.col("_k"), "left")
            .withColumn("action", F.when(F.col("_hit"), F.lit("update")).otherwise(F.lit("insert")))
            .drop("_k", "_hit"))
