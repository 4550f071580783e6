from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators import reports as R
from ledgerlens.session import scratch_path
from ledgerlens.sources.versions import read_current


def _classified(spark):
    rows = [("A", "local", Decimal("10.00"), "2020-01-05"), ("A", "local", Decimal("10.00"), "2020-02-05"),
            ("A", "state", Decimal("30.00"), "2020-02-06"), ("B", "local", Decimal("5.00"), "2021-03-01")]
    return (spark.createDataFrame(rows, "violation_type string, scope string, revenue decimal(18,2), d string")
            .withColumn("violation_date", F.to_timestamp("d")))


def test_pivots_null_when_absent_and_sum_to_rows(spark):
    df = _classified(spark)
    counts = {r.violation_type: (r.local, r.state) for r in R.counts_by_type_scope(df).collect()}
    assert counts == {"A": (2, 1), "B": (1, None)}
    assert sum((a or 0) + (b or 0) for a, b in counts.values()) == df.count()
    rev = {r.violation_type: (r.local, r.state) for r in R.revenue_by_type_scope(df).collect()}
    assert rev == {"A": (Decimal("20.00"), Decimal("30.00")), "B": (Decimal("5.00"), None)}


def test_month_revenue_and_span(spark):
    df = _classified(spark)
    months = {r.month: (r.local, r.state) for r in R.month_revenue(df).collect()}
    assert months["2020-02"] == (Decimal("10.00"), Decimal("30.00"))
    assert R.months_spanned(df).first().months == 15  # Jan 2020 .. Mar 2021 inclusive


def _metrics(spark):
    cols = ["idx", "violation"] + [c[len("sum_"):] for c in
                                   __import__("ledgerlens.fixed_values", fromlist=["x"]).TOTAL_COLUMNS]
    rows = [(0, "X") + tuple(Decimal(i + 1) for i in range(13)), (1, "Y") + tuple(Decimal(2 * (i + 1)) for i in range(13))]
    schema = "idx long, violation string, " + ", ".join(f"{c} decimal(18,2)" for c in cols[2:])
    return spark.createDataFrame(rows, schema)


def test_totals_and_report_rollup(spark):
    m = _metrics(spark)
    totals = R.metrics_totals(m).first()
    assert totals.sum_local_citations == Decimal(3) and totals.sum_nopd_lost_revenue == Decimal(39)
    long = {r.type_of_total: r.value for r in R.totals_long(R.metrics_totals(m)).collect()}
    assert len(long) == 13 and long["sum_nopd_lost_revenue"] == 39.0
    rep = {r["Violation"]: r for r in R.citation_report(m).collect()}
    assert set(rep) == {"X", "Y", "Total NOPD Citations"}
    total = rep["Total NOPD Citations"]
    assert total["NOPD Local Citations"] == rep["X"]["NOPD Local Citations"] + rep["Y"]["NOPD Local Citations"]
    assert total["line"] is None


def test_detail_and_totals_come_from_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    counted = F.udf(count, "long").asNondeterministic()
    m = _metrics(spark).repartition(3).withColumn("idx", counted("idx"))
    detail, totals = scratch_path(spark, "detail"), scratch_path(spark, "totals")
    R.write_metrics(m, detail, totals)
    assert seen.value == 2
    want = R.metrics_totals(_metrics(spark))
    got = read_current(spark, totals)
    assert got.schema == want.schema and got.collect() == want.collect()
    assert sorted(read_current(spark, detail).collect()) == sorted(_metrics(spark).collect())


def test_totals_of_an_empty_detail(spark):
    for empty in (_metrics(spark).filter("idx < 0"), _metrics(spark).limit(0), _metrics(spark).filter(F.lit(False))):
        detail, totals = scratch_path(spark, "detail"), scratch_path(spark, "totals")
        R.write_metrics(empty, detail, totals)
        assert [set(r) for r in read_current(spark, totals).collect()] == [{None}]
        assert read_current(spark, detail).count() == 0


def test_impact_zero_months_is_null(spark):
    df = spark.createDataFrame([(1200.0, 0), (1200.0, 24)], "lost double, months int")
    out = df.select(*R.revenue_impact(F.col("lost"), F.col("months"), F.lit(0.5))).collect()
    assert out[0].average_monthly_revenue_lost is None and out[0].annualized_lost_revenue is None
    assert out[1].average_monthly_revenue_lost == 50.0 and out[1].annualized_lost_revenue == 600.0
    assert out[1].estimated_annual_revenue_impact == 300.0


def test_impact_long_and_trace(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 1.0)], "average_monthly_revenue_lost double, "
                               "annualized_lost_revenue double, collection_rate double, estimated_annual_revenue_impact double")
    assert R.impact_long(df).count() == 4


def test_null_class_rows_are_not_a_group(spark):
    rows = [("A", "local", Decimal("1.00")), (None, None, None)]
    df = spark.createDataFrame(rows, "violation_type string, scope string, revenue decimal(18,2)")
    assert [tuple(r) for r in R.counts_by_type_scope(df).collect()] == [("A", 1, None)]
