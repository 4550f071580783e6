from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens import fixed_values as FV
from ledgerlens.operators import classify as C

RULES = [("Brand#11", 157.50, "A", "local"), ("Brand#1", 302.50, "A", "state"), ("Brand#2", 227.50, "B", "local")]
DEFAULT = (302.50, "C", "state")


def _codes(spark, codes):
    return spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "k long, violation_code string")


def test_first_match_default_and_null(spark):
    df = _codes(spark, ["Brand#11x", "Brand#1", "Brand#2", "Zzz", None])
    out = {r.k: (r.revenue, r.violation_type, r.scope)
           for r in C.classify_prefix(df, "violation_code", RULES, DEFAULT).collect()}
    assert out[0] == (Decimal("157.50"), "A", "local")  # matches two rules: the first wins
    assert out[1] == (Decimal("302.50"), "A", "state")
    assert out[2] == (Decimal("227.50"), "B", "local")
    assert out[3] == (Decimal("302.50"), "C", "state")  # no match: default
    assert out[4] == (None, None, None)  # NULL code: NULL class


def test_rule_join_equals_case(spark):
    codes = [f"Brand#{i}{j}" for i in range(1, 4) for j in ("", "1", "x")] + ["", None, "B", "Brand#"]
    df = _codes(spark, codes)
    rules = C.rules_frame(spark, RULES)
    a = C.classify_prefix(df, "violation_code", RULES, DEFAULT).orderBy("k").collect()
    b = C.classify_by_rules(df, rules, "violation_code", DEFAULT).orderBy("k").collect()
    assert a == b


def test_catch_all_rule_matches_in_both_forms(spark):
    rules = [*RULES, ("", 1.0, "any", "state")]
    df = _codes(spark, ["Brand#11", "zzz", "", None])
    a = C.classify_prefix(df, "violation_code", rules, DEFAULT).orderBy("k").collect()
    b = C.classify_by_rules(df, C.rules_frame(spark, rules), "violation_code", DEFAULT).orderBy("k").collect()
    assert a == b and [r.violation_type for r in a] == ["A", "any", "any", None]


def test_rule_join_leaves_the_rows_where_they_are(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.classify_by_rules(_codes(spark, ["Brand#11"]), C.rules_frame(spark, RULES))
        plan = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange hashpartitioning" not in plan


def test_rule_join_plans_no_nested_loop(spark):
    df = _codes(spark, ["Brand#11", "Brand#2"])
    plan = C.classify_by_rules(df, C.rules_frame(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan


def test_reference_rules_prefix_not_exact(spark):
    # A code equal to a prefix plus a suffix is classified by the prefix.
    df = _codes(spark, ["154:383.1", "32:53D-2", "99:1"])
    out = {r.k: r.violation_type for r in C.classify_prefix(df).collect()}
    assert out == {0: "Careless operation of a vehicle", 1: "No/expired brake tag", 2: FV.CITATION_DEFAULT[1]}


def test_agency_filter_exact(spark):
    df = spark.createDataFrame([("01 - CITY POLICE",), ("01 - city police",), (None,)], "department string")
    assert C.agency_filter(df).count() == 1


def test_scope_of_ref(spark):
    df = spark.createDataFrame([("154:1",), ("32:1",)], "r string")
    assert [r.s for r in df.select(C.scope_of_ref(F.col("r")).alias("s")).collect()] == ["local", "state"]


def test_ranges_equal_case_chain(spark):
    rules = [*RULES, ("Brand#11x", 9.0, "late", "state"), ("\U0010ffff", 3.0, "top", "local"), ("\ud7ff", 4.0, "edge", "local"),
             ("a\U0010ffff", 5.0, "carry", "state"), ("Brand#1", 7.0, "again", "state")]
    codes = [f"Brand#{i}{j}" for i in range(1, 4) for j in ("", "1", "1x", "x", "\U0010ffff")] + [
        "", None, "B", "Brand#", "\U0010ffff", "\U0010ffffz", "\ud7ff", "\ud7ffa", "\ue000", "a", "a\U0010ffff", "a\U0010ffffq", "b"]
    df = _codes(spark, codes).withColumn("edge", F.lit("x"))
    for listed in (rules, RULES, [*rules, ("", 1.0, "any", "state")], []):
        for default in (DEFAULT, None):
            a = C.classify_prefix(df, "violation_code", listed, default).orderBy("k").collect()
            assert a == C.classify_by_ranges(df, listed, "violation_code", default).orderBy("k").collect()


def test_many_rules_need_no_exchange_and_no_job(spark):
    import random

    rng = random.Random(3)
    rules = list({f"{rng.randrange(10**rng.randint(2, 7))}": None for _ in range(110_000)})
    rules = [(p, float(i % 50), f"t{i}", "state") for i, p in enumerate(rules[:100_000])]
    codes = [str(rng.randrange(10**rng.randint(1, 9))) for _ in range(3000)]
    df = _codes(spark, codes)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranges", "calls only")
    out = C.classify_by_ranges(df, rules, "violation_code", DEFAULT)
    assert list(tracker.getJobIdsForGroup("ranges")) == []
    plan = out._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in plan and "Join" not in plan
    first = {}
    for i, r in enumerate(rules):
        first.setdefault(r[0], i)
    for row in out.collect():
        want = min((first[row.violation_code[:n]] for n in range(len(row.violation_code) + 1) if row.violation_code[:n] in first), default=None)
        assert row.violation_type == ("C" if want is None else f"t{want}")
