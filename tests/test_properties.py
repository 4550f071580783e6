"""Property tests (hypothesis) on small random inputs; few examples since each runs Spark jobs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import text as TX
from ledgerlens.operators import classify as C
from ledgerlens.operators import retrieval as RT

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
code = st.text(alphabet="ab1:", min_size=0, max_size=5)


@SETTINGS
@given(prefixes=st.lists(st.text(alphabet="ab1:", min_size=1, max_size=3), min_size=1, max_size=6),
       codes=st.lists(st.one_of(st.none(), code), min_size=1, max_size=12))
def test_case_chain_equals_rule_join(spark, prefixes, codes):
    rules = [(p, float(i + 1), f"T{i}", "local" if i % 2 else "state") for i, p in enumerate(prefixes)]
    default = (99.0, "D", "state")
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "k long, violation_code string")
    a = sorted(C.classify_prefix(df, "violation_code", rules, default).collect())
    b = sorted(C.classify_by_rules(df, C.rules_frame(spark, rules), "violation_code", default).collect())
    assert a == b


@SETTINGS
@given(tokens=st.lists(st.integers(min_value=0, max_value=20), min_size=1, max_size=15),
       budget=st.integers(min_value=0, max_value=80))
def test_pack_is_budgeted_prefix(spark, tokens, budget):
    df = spark.createDataFrame([(1, r + 1, t) for r, t in enumerate(tokens)], "qid int, rank int, tokens long")
    kept = [r["rank"] for r in RT.pack_to_budget(df, "qid", "rank", "tokens", budget).orderBy("rank").collect()]
    expect, total = [], 0
    for r, t in enumerate(tokens):
        if total + t > budget:
            break
        total += t
        expect.append(r + 1)
    assert kept == expect


@SETTINGS
@given(parts=st.lists(st.text(alphabet="ab ,.!é\n", min_size=0, max_size=12), min_size=1, max_size=5))
def test_token_count_additive_over_newlines(spark, parts):
    rows = [("\n".join(parts),)] + [(p,) for p in parts]
    counts = [r.n for r in spark.createDataFrame(rows, "t string").select(TX.token_count(F.col("t")).alias("n")).collect()]
    assert counts[0] == sum(counts[1:])
