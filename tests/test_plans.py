"""Plan shape checks: one scan per input, no Python in native operators."""

import re

import __spark_entry__ as E

PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas",
                "FlatMapCoGroupsInPandas", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_code_counts_scans_each_input_once(spark, sf_dir):
    plan = _plan(E.queries()["exact_code_counts"](spark, sf_dir))
    assert len(re.findall(r"lineitem\.parquet", plan)) == 1
    assert len(re.findall(r"orders\.parquet", plan)) == 1


def test_native_queries_have_no_python(spark, sf_dir):
    for name in ["citations_by_type_scope", "classify_rule_join", "violation_metrics", "revenue_report",
                 "clean_text", "token_count", "running_context", "usage_cost", "route_messages",
                 "extractive_context", "union_renumber"]:
        plan = _plan(E.queries()[name](spark, sf_dir))
        assert not any(n in plan for n in PYTHON_NODES), name


def test_agency_filter_pushed_to_scan(spark, sf_dir):
    df = E.queries()["citations_by_type_scope"](spark, sf_dir)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_prefix_counts_at_least_exact_counts(spark, sf_dir):
    """A code equal to an unshadowed rule prefix: rows classified by that rule >= rows with that exact code."""
    from pyspark.sql import functions as F

    from ledgerlens.operators import classify as C
    from ledgerlens.plans import standins as S
    cites = S.citations(spark, sf_dir)
    classified = C.classify_prefix(cites, "violation_code", S.BRAND_RULES, S.BRAND_DEFAULT)
    # 'Brand#2' is the third rule and no earlier rule is a prefix of it.
    by_rule = classified.filter((F.col("violation_type") == "B") & (F.col("scope") == "local")).count()
    exact = cites.filter(F.col("violation_code") == "Brand#2").count()
    assert by_rule >= exact > 0
