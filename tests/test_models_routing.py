import functools

import providers
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerlens.operators import models as M
from ledgerlens.operators.routing import route_file, route_messages

cloudpickle.register_pickle_by_value(providers)  # workers do not have the tests on their path


def test_complete_batch_fallback(spark):
    df = spark.createDataFrame([(1, "short prompt\nanswer line"), (2, "x " * 50)], "id long, prompt string")
    primary = functools.partial(providers.LastLine, "primary", 10)
    fallback = functools.partial(providers.LastLine, "fallback")
    out = {r.id: r for r in M.complete_batch(df, "id", "prompt", primary, fallback).collect()}
    assert out[1].provider == "primary" and out[1].content == "answer line"
    assert out[2].provider == "fallback" and out[2].error is None


def test_complete_batch_halves_a_failing_batch():
    calls = []

    class Counting(providers.LastLine):
        def complete(self, prompts):
            calls.append(len(prompts))
            return super().complete(prompts)

    prompts = ["ok"] * 40 + ["x " * 50] + ["ok"] * 23
    out = M._answers(prompts, Counting("primary", 10), providers.LastLine("fallback"))
    assert [a[1] for a in out] == ["primary"] * 40 + ["fallback"] + ["primary"] * 23
    assert len(calls) <= 2 * 6 + 1  # not one call per prompt


def test_complete_batch_error_recorded(spark):
    df = spark.createDataFrame([(1, "p")], "id long, prompt string")
    out = M.complete_batch(df, "id", "prompt", providers.Failing, None).first()
    assert out.content is None and "unavailable" in out.error


def test_usage_cost(spark):
    usage = spark.createDataFrame([("m1", 1000, 2000), ("m1", 500, 0), ("m2", 10, 10)],
                                  "model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("m1", 0.01, 0.03)], "model string, prompt_price double, completion_price double")
    out = {r.model: r for r in M.usage_cost(usage, prices).collect()}
    assert out["m1"].requests == 2 and abs(out["m1"].cost - (1500 * 0.01 + 2000 * 0.03) / 1000) < 1e-12
    assert out["m2"].cost is None


def test_embed_hashing_unit_norm(spark):
    df = spark.createDataFrame([(1, "Hello, world! hello"), (2, "")], "id long, text string")
    rows = {r.id: r.embedding for r in M.embed_hashing(df, "text", dims=32).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1.0) < 1e-9 and len(rows[1]) == 32


def test_route_messages_and_files(spark):
    msgs = spark.createDataFrame([(1, "/start"), (2, "/unknown@bot x"), (3, None), (4, "hello")], "id int, text string")
    out = {r.id: (r.route, r.command) for r in route_messages(msgs).collect()}
    assert out == {1: ("command", "start"), 2: ("command", "unknown"), 3: ("non_text", None), 4: ("question", None)}
    files = spark.createDataFrame([("a.xlsx",), ("b.xls",), ("c.docx",), ("d.doc",), ("report.XLSX",), ("e.pdf",)], "p string")
    acts = [r.a for r in files.select(route_file(F.col("p")).alias("a")).collect()]
    assert acts == ["analyse", "analyse", "store", "store", "reject", "reject"]


def test_write_reports_sequential(spark):
    sections = spark.createDataFrame(
        [(1, 0, "Title", "Write a title"), (1, 1, "Body", "Write the body"), (2, 0, "Title", "Other title")],
        "report_id long, ordinal long, label string, prompt string")
    out = {(r.report_id, r.ordinal): r for r in M.write_reports(sections, "Instr", F.lit("t1 1.00"), providers.LastLine).collect()}
    assert len(out) == 3 and out[(1, 1)].provider == "last-line"
    # The local provider answers with the last line of the request, i.e. the task line.
    assert out[(1, 1)].content == "Task: Write the body"


def test_embed_with_provider(spark):
    df = spark.createDataFrame([(1, "Red apples, red!"), (2, None)], "id long, text string")
    rows = {r.id: r.embedding for r in M.embed_with_provider(df, "id", "text", providers.WordCounts).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1.0) < 1e-9 and len(rows[1]) == 256
    assert sum(rows[2]) == 0.0


def test_usage_cost_with_high_prices(spark):
    usage = spark.createDataFrame([("m", 2000, 10)], "model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("m", 150.0, 250_000.0)], "model string, prompt_price double, completion_price double")
    assert M.usage_cost(usage, prices).first().cost == 2 * 150 + 2500


def test_embed_hashing_null_text_is_empty(spark):
    from pyspark.ml.feature import HashingTF

    df = spark.createDataFrame([(1, None), (2, ""), (3, "Pear, apple pear")], "id long, text string")
    rows = {r.id: r.embedding for r in M.embed_hashing(df, "text", dims=64).collect()}
    assert sum(rows[1]) == 0 and rows[1] == rows[2]
    tf, want = HashingTF(numFeatures=64), [0.0] * 64
    for w in ("pear", "apple", "pear"):
        want[tf.indexOf(w)] += 1
    n = sum(x * x for x in want) ** 0.5
    assert all(abs(a - b / n) < 1e-12 for a, b in zip(rows[3], want))


def test_answered_requests_are_never_asked_again(spark, tmp_path):
    import pytest

    from ledgerlens.operators.models import complete_once
    from ledgerlens.session import scratch_path

    class Dying:
        """Answers, notes every prompt in a file, and ends the task at the ``die_at``-th call of a worker."""

        name = "dying"

        def __init__(self, log, die_at=None):
            self.log, self.die_at, self.calls = log, die_at, 0

        def complete(self, prompts):
            self.calls += 1
            if self.calls == self.die_at:
                raise KeyboardInterrupt("the worker is lost")
            if any("bad" in p for p in prompts):
                raise ValueError("refused")
            with open(self.log, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return [(p.upper(), 1, 1) for p in prompts]

    log, store = str(tmp_path / "asked"), scratch_path(spark, "answers")
    rows = [(i, f"p{i % 40}") for i in range(60)] + [(100, None), (101, "bad one")]
    df = spark.createDataFrame(rows, "id long, prompt string").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        with pytest.raises(Exception, match="lost"):
            complete_once(df, "id", "prompt", lambda: Dying(log, 3), None, store)
        first = open(log).read().split("\n")[:-1]
        assert 0 < len(first) < 41
        got = {r.id: (r.content, r.provider, r.error) for r in complete_once(df, "id", "prompt", lambda: Dying(log), None, store).collect()}
        asked = open(log).read().split("\n")[:-1]
        assert len(asked) == len(set(asked)) == 41 and asked[:len(first)] == first  # each prompt once, over both runs
        again = {r.id: (r.content, r.provider, r.error) for r in complete_once(df, "id", "prompt", lambda: Dying(log), None, store).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert open(log).read().split("\n")[:-1] == asked and again == got and len(got) == len(rows)
    assert got[5] == got[45] == ("P5", "dying", None) and got[100][0] == "" and got[101] == (None, None, "ValueError: refused")
