from decimal import Decimal

from ledgerlens.operators import violations as V
from ledgerlens.operators.ordering import dense_index, take_until_null

VT = [  # (ordinal, ref, violation)
    (0, "154:1", "Speeding"),
    (1, "32:1", "Speeding"),
    (2, "154:2", "Parking"),
    (3, "154:9", "Speeding"),  # a later local code for Speeding wins
    (4, "32:1", "Noise"),      # the same state code under two violations
    (5, None, "Ignored"),      # first NULL code: this row and all later rows are dropped
    (6, "154:7", "Late"),
]
CITES = [  # (department, code)
    ("A", "154:9"), ("A", "154:9"), ("B", "154:9"), ("A", "32:1"), ("B", "32:1"), ("A", "154:2"),
    ("A", "154:1"), ("A", "154:383.1"), ("A", None),
]


def _frames(spark):
    vt = spark.createDataFrame(VT, "ordinal long, ref string, violation string")
    cites = spark.createDataFrame(CITES, "department string, violation_code string")
    return vt, cites


def test_merge_last_wins_first_appearance(spark):
    vt, _ = _frames(spark)
    rows = {r.violation: r for r in V.merge_violation_refs(vt, local_prefix="154").collect()}
    assert set(rows) == {"Speeding", "Parking", "Noise"}
    assert (rows["Speeding"].local_ref, rows["Speeding"].state_ref, rows["Speeding"].idx) == ("154:9", "32:1", 0)
    assert (rows["Parking"].local_ref, rows["Parking"].state_ref, rows["Parking"].idx) == ("154:2", None, 1)
    assert (rows["Noise"].local_ref, rows["Noise"].state_ref, rows["Noise"].idx) == (None, "32:1", 2)


def test_exact_counts_and_metrics(spark):
    vt, cites = _frames(spark)
    merged = V.merge_violation_refs(vt, local_prefix="154")
    counted = V.exact_code_counts(merged, cites, agency="A")
    fines = spark.createDataFrame([(0, Decimal("100.00"), Decimal("250.00")), (1, Decimal("50.00"), None),
                                   (2, Decimal("80.00"), Decimal("90.00"))],
                                  "ordinal long, local_fine decimal(18,2), state_fine decimal(18,2)")
    m = {r.violation: r for r in V.violation_metrics(V.join_fines_positional(counted, fines)).collect()}
    s = m["Speeding"]
    assert (s.local_citations, s.nopd_local_citations, s.state_citations, s.nopd_state_citations) == (3, 2, 2, 1)
    assert s.local_citation_revenue == Decimal("300.00")
    assert s.nopd_lost_revenue == 2 * Decimal("250.00") - 2 * Decimal("100.00")
    assert s.fine_difference == Decimal("150.00") and s.citation_difference == 1
    p = m["Parking"]  # no state code: count 0; missing state fine: NULL revenue
    assert p.state_citations == 0 and p.state_citation_revenue is None and p.nopd_lost_revenue is None
    n = m["Noise"]  # the shared code counts fully for both violations
    assert n.state_citations == 2 and n.local_citations == 0


def test_fill_missing_keeps_existing(spark):
    existing = spark.createDataFrame([(1, 5.0), (2, None)], "k long, v double")
    computed = spark.createDataFrame([(1, 9.0), (2, 7.0)], "k long, v double")
    assert sorted(V.fill_missing(existing, computed, ["k"], ["v"]).collect()) == [(1, 5.0), (2, 7.0)]


def test_membership_split(spark):
    existing = spark.createDataFrame([("a",), ("b",)], "v string")
    incoming = spark.createDataFrame([("a",), ("c",), (None,)], "v string")
    out = sorted((r.v or "", r.action) for r in V.membership_split(incoming, existing, "v").collect())
    assert out == [("", "insert"), ("a", "update"), ("c", "insert")]


def test_take_until_null(spark):
    df = spark.createDataFrame([(i, None if i == 4 else "x") for i in range(10)], "o long, k string")
    assert sorted(r.o for r in take_until_null(df, "k", "o").collect()) == [0, 1, 2, 3]
    full = spark.createDataFrame([(i, "x") for i in range(5)], "o long, k string")
    assert take_until_null(full, "k", "o").count() == 5


def test_dense_index_matches_global_order(spark):
    import random
    keys = list(range(5000))
    random.Random(3).shuffle(keys)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string").repartition(7)
    out = dense_index(df, ["k"], start=0).collect()
    assert sorted((r.k, r.idx) for r in out) == [(k, k) for k in range(5000)]


def test_end_to_end_hand_fixture(spark):
    """Merge -> counts -> fines -> metrics -> totals -> report -> impact on hand-computed numbers."""
    from pyspark.sql import functions as F

    from ledgerlens.operators import reports as R

    vt, cites = _frames(spark)
    merged = V.merge_violation_refs(vt, local_prefix="154")
    fines = spark.createDataFrame([(0, Decimal("100.00"), Decimal("250.00")), (1, Decimal("50.00"), None),
                                   (2, Decimal("80.00"), Decimal("90.00"))],
                                  "ordinal long, local_fine decimal(18,2), state_fine decimal(18,2)")
    metrics = V.violation_metrics(V.join_fines_positional(V.exact_code_counts(merged, cites, agency="A"), fines))
    m = {r.violation: r for r in metrics.collect()}
    assert m["Speeding"].nopd_lost_revenue == Decimal("300.00")
    assert m["Speeding"].nopd_total_revenue_local_as_state == Decimal("750.00")
    assert m["Parking"].nopd_lost_revenue is None and m["Noise"].nopd_lost_revenue == Decimal("0.00")
    totals = R.metrics_totals(metrics).first()
    assert totals.sum_nopd_lost_revenue == Decimal("300.00")
    assert (totals.sum_nopd_local_citations, totals.sum_nopd_state_citations) == (3, 2)
    report = {r["Violation"]: r for r in R.revenue_report(metrics).collect()}
    assert report["Total NOPD Revenue"]["NOPD Lost Revenue"] == Decimal("300.00")
    impact = R.metrics_totals(metrics).select(
        *R.revenue_impact(F.col("sum_nopd_lost_revenue"), F.lit(12), F.lit(0.5))).first()
    assert (impact.average_monthly_revenue_lost, impact.annualized_lost_revenue,
            impact.estimated_annual_revenue_impact) == (25.0, 300.0, 150.0)
    trace = R.calc_trace(metrics).filter(F.col("violation") == "Speeding").orderBy("step").collect()
    assert len(trace) == 12 and trace[-2].line.endswith("500.00 - 200.00 = 300.00")
    assert trace[-1].line == "a state fine exceeds the local one by 150.00"
    steps = R.impact_trace(R.metrics_totals(metrics).select(
        F.col("sum_nopd_lost_revenue"), F.lit(12).alias("number_of_months"),
        *R.revenue_impact(F.col("sum_nopd_lost_revenue"), F.lit(12), F.lit(0.5)))).orderBy("step").collect()
    assert [r.line.split(": ")[1] for r in steps] == ["300.00 / 12 = 25.00", "25.00 * 12 = 300.00", "300.00 * 0.50 = 150.00"]


def test_spread_only_when_asked(spark):
    from ledgerlens.operators.ordering import spread
    one = spark.range(100).coalesce(1)
    assert spread(one, 8).rdd.getNumPartitions() == 8 and spread(one).rdd.getNumPartitions() == 1


def test_dense_index_with_nulls_repeats_and_leading_keys(spark):
    rows = [(p, None if k == 7 else k // 2 * 10 + p) for p in (0, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "part int, k long").repartition(5)
    out = sorted(dense_index(df, ["part", "k"], fanout=4).collect(), key=lambda r: r.idx)
    assert [r.idx for r in out] == list(range(600))
    assert [(r.part, -1 if r.k is None else r.k) for r in out] == sorted((p, -1 if k is None else k) for p, k in rows)


def test_violation_queries_run_no_job_when_called(spark, sf_dir):
    import __spark_entry__ as E
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "calls only")
    for name in ("violation_ref_merge", "union_renumber", "exact_code_counts", "revenue_report"):
        E.queries()[name](spark, sf_dir)
    assert list(tracker.getJobIdsForGroup("lazy")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_running_sum_before_keeps_null_keys(spark):
    from ledgerlens.operators.ordering import running_sum_before
    rows = [(None, 1, 5), (None, 2, 6), (1, None, 7), (1, 3, 8)]
    df = spark.createDataFrame(rows, "g long, t long, v long")
    got = {(r.g, r.t): r.s for r in running_sum_before(df, "g", "t", "v", "s").collect()}
    assert got == {(None, 1): 0, (None, 2): 5, (1, None): 0, (1, 3): 7}


def test_running_context_of_one_long_conversation(spark):
    from pyspark.sql import functions as F

    from ledgerlens.operators.documents import running_context
    rows = [(0, t, f"m{t};") for t in range(400)] + [(g, t, f"g{g}t{t};") for g in range(1, 100) for t in range(8)]
    df = spark.createDataFrame(rows, "g long, t long, x string").repartition(6)
    got = {(r.g, r.t): r.context for r in running_context(df, "g", "t", F.col("x"), chunk=16).collect()}
    for g, t, _ in rows:
        assert got[g, t] == "".join(x for h, u, x in rows if h == g and u < t)
    some = running_context(df, "g", "t", F.col("x"), chunk=16, wanted=F.col("t") % 100 == 0).collect()
    assert len(some) == 4 + 99 and all(got[r.g, r.t] == r.context for r in some)


def test_running_context_levels_sums_and_null_keys(spark):
    from pyspark.sql import functions as F

    from ledgerlens.operators.documents import running_context
    rows = [(0, t * 3, f"m{t};") for t in range(-40, 260)] + [(None, t, f"n{t};") for t in range(30)]
    rows += [(7, None, "null;"), (7, 10**12, "late;"), (7, -10**12, "early;"), (8, 1, None), (8, 2, "x")]
    df = spark.createDataFrame(rows, "g long, t long, x string").repartition(5)
    order = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)))}
    for levels in (1, 2, 3):
        out = running_context(df, "g", "t", F.col("x"), chunk=4, fan=3, levels=levels, wanted=F.col("t").isNull() | (F.col("t") % 2 == 0),
                              count=F.coalesce(F.length("x"), F.lit(0)), count_name="chars").collect()
        assert len(out) == sum(t is None or t % 2 == 0 for _, t, _ in rows)
        for r in out:
            want = "".join(x or "" for x in (z[2] for z in sorted(
                (q for q in rows if q[0] == r.g and order[q] < order[(r.g, r.t, r.x)]), key=order.get)))
            assert (r.context, r.chars) == (want, len(want)), (levels, r.g, r.t)


def test_running_context_windows_are_bounded(spark):
    """A third of all rows in one conversation: no task of the scan sees more than a chunk or the siblings of one parent."""
    from pyspark.sql import functions as F

    from ledgerlens.operators.documents import running_context
    df = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id")).alias("g"), F.col("id").alias("t"),
                                    F.lit("ab").alias("x"))
    out = running_context(df, "g", "t", F.col("x"), chunk=64, fan=16, wanted=F.col("t") == 9_999)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("], [")[1] for line in plan.splitlines() if "Window [" in line]
    assert len(keys) == 3 and sum(k.count("#") == 2 for k in keys) == 2  # (group, chunk), (group, parent), group of parents
    assert out.first()["context"] == "ab" * 9_999 and out.count() == 1


def test_running_sum_before_matches_window(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ledgerlens.operators.ordering import running_sum_before
    rng = random.Random(5)
    rows = [(g, t, rng.randint(0, 9)) for g in range(3) for t in range(0, 50 if g else 500)]
    df = spark.createDataFrame(rows, "g long, t long, v long")
    got = sorted(tuple(r) for r in running_sum_before(df, "g", "t", "v", "s", chunk=16).select("g", "t", "s").collect())
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    want = sorted(tuple(r) for r in df.select("g", "t", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s")).collect())
    assert got == want


def test_order_dependent_ops_ignore_physical_order(spark):
    """Merge, take-until-null and renumbering depend on the ordinal only, not on row order."""
    import random

    from pyspark.sql import functions as F

    from ledgerlens.operators.documents import union_renumber
    rows = list(VT)
    results = []
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        vt = spark.createDataFrame(rows, "ordinal long, ref string, violation string").repartition(3)
        merged = sorted(tuple(r) for r in V.merge_violation_refs(vt, local_prefix="154").collect())
        a = spark.createDataFrame([(i, f"a{i}") for i in random.Random(seed).sample(range(40), 40)], "ordinal long, n string")
        b = spark.createDataFrame([(i, f"b{i}") for i in random.Random(seed).sample(range(30), 30)], "ordinal long, n string")
        renum = sorted(tuple(r) for r in union_renumber([("a", a.repartition(4)), ("b", b.repartition(2))])
                       .select("source", "ordinal", "idx").collect())
        results.append((merged, renum))
    assert results[0] == results[1] == results[2]
    assert results[0][1][0] == ("a", 0, 0) and results[0][1][-1] == ("b", 29, 69)
