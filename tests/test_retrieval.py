import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import retrieval as RT


def _brute(corpus, queries, k):
    out = {}
    for qid, q in queries:
        scored = []
        for cid, v in corpus:
            v, qq = np.asarray(v, float), np.asarray(q, float)
            den = np.linalg.norm(v) * np.linalg.norm(qq)
            s = None if den == 0 else round(float(v @ qq / den), 6)
            scored.append((cid, s))
        scored.sort(key=lambda t: (t[1] is None, -(t[1] or 0), t[0]))
        out[qid] = scored[:k]
    return out


def _data(n=300, d=16, seed=1):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(n, d)).round(2)
    vecs[5] = 0.0            # zero vector: NULL similarity, ranked last
    vecs[7] = vecs[3]        # exact tie: lower id first
    corpus = [(i, vecs[i].tolist()) for i in range(n)]
    queries = [(q, rng.normal(size=d).round(2).tolist()) for q in range(4)]
    return corpus, queries


def _frames(spark, corpus, queries):
    c = spark.createDataFrame(corpus, "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(queries, "qid int, qvec array<double>")
    return c, q


def _result(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, r.similarity))
    return out


def test_topk_matches_brute_force(spark):
    corpus, queries = _data()
    c, q = _frames(spark, corpus, queries)
    assert _result(RT.top_k_similar(c, q, 10)) == _brute(corpus, queries, 10)


def test_topk_blocked_path_matches(spark):
    corpus, queries = _data(seed=2)
    c, q = _frames(spark, corpus, queries)
    blocked = RT.top_k_similar(c, q, 7, max_broadcast_bytes=100)
    assert _result(blocked) == _brute(corpus, queries, 7)


def test_topk_k_larger_than_corpus_keeps_nulls_last(spark):
    corpus, queries = _data(n=12)
    c, q = _frames(spark, corpus, queries)
    res = _result(RT.top_k_similar(c, q, 50))
    assert all(len(v) == 12 and v[-1] == (5, None) for v in res.values())


def test_empty_corpus(spark):
    _, queries = _data()
    c = spark.createDataFrame([], "vec_id long, embedding array<double>")
    q = spark.createDataFrame(queries, "qid int, qvec array<double>")
    assert RT.top_k_similar(c, q, 3).count() == 0


def test_short_vector_first_in_a_batch_changes_nothing(spark):
    corpus, queries = _data(n=20)
    odd = [(100, [1.0]), (101, None), (102, [1.0] * 15 + [None]), *corpus]
    c = spark.createDataFrame(odd, "vec_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame(queries, "qid int, qvec array<double>")
    got, want = _result(RT.top_k_similar(c, q, 50)), _brute(corpus, queries, 50)
    for qid, rows in got.items():
        assert rows[:19] == want[qid][:19]
        assert sorted(i for i, s in rows if s is None) == [5, 100, 101, 102]


def test_ranked_on_full_precision(spark):
    c = spark.createDataFrame([(1, [1.0, 1e-4]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, qvec array<double>")
    assert _result(RT.top_k_similar(c, q, 1)) == {0: [(2, 1.0)]}


def test_scorer_is_replaceable(spark):
    corpus, queries = _data(n=30)
    c, q = _frames(spark, corpus, queries)
    got = _result(RT.top_k_similar(c, q, 3, scorer=lambda r, s: r @ s.T))
    for qid, v in queries:
        order = sorted(corpus, key=lambda x: (-round(float(np.dot(x[1], v)), 12), x[0]))[:3]
        assert [i for i, _ in got[qid]] == [i for i, _ in order]


def test_many_queries_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    rows, queries = rng.normal(size=(3000, 8)), rng.normal(size=(200_000, 8))
    tracemalloc.start()
    n = sum(len(q) for q, _, _ in RT._top_of_tiles(rows, np.arange(3000), queries, 2, RT.cosine_scores))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_000 and peak < 400 << 20  # all scores together would take 4.8 GB


def test_texts_are_not_shuffled_for_a_small_ranking(spark, sf_dir):
    from ledgerlens.plans import retrieval_queries as RQ

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = RQ.relatedness_report(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_topk_plan_has_group_limit(spark):
    corpus, queries = _data(n=50)
    c, q = _frames(spark, corpus, queries)
    plan = RT.top_k_similar(c, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pack_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 4), (1, 2, 5), (1, 3, 9), (1, 4, 1)], "qid int, rank int, tokens long")
    kept = RT.pack_to_budget(df, "qid", "rank", "tokens", 10)
    assert [r["rank"] for r in kept.orderBy("rank").collect()] == [1, 2]


def test_prompt_without_passages(spark):
    questions = spark.createDataFrame([(1, "why?")], "qid int, question string")
    ranked = spark.createDataFrame([(1, 1, 10, "word " * 5000)], "qid int, rank int, id long, text string")
    packed = RT.context_pack(ranked, questions, budget=100)
    assert packed.count() == 0
    p = RT.retrieval_prompt(packed, questions).first()
    assert p.n_passages == 0 and p.prompt == RT.DEFAULT_INTRO + RT.DEFAULT_QUESTION_PREFIX + "why?"


def test_prompt_is_prefix_of_ranking_within_budget(spark):
    questions = spark.createDataFrame([(1, "alpha beta")], "qid int, question string")
    ranked = spark.createDataFrame([(1, r, r, f"text {r} " * r) for r in range(1, 30)],
                                   "qid int, rank int, id long, text string")
    packed = RT.context_pack(ranked, questions, budget=200).orderBy("rank").collect()
    ranks = [r["rank"] for r in packed]
    assert ranks == list(range(1, len(ranks) + 1)) and packed[-1].cum_tokens + packed[-1].fixed_tokens <= 200


def test_extractive_context(spark):
    q = spark.createDataFrame([(1, "red apples and pears")], "k long, question string")
    t = spark.createDataFrame([(1, 0, "I like red apples\nnothing here\npears are fine"), (1, 1, "Apples apples")],
                              "k long, ordinal long, text string")
    out = RT.extractive_context(q, t, "k", budget=500).first()
    assert out.context == "I like red apples\npears are fine\nApples apples" and out.n_lines == 3


def test_extractive_context_keeps_every_question(spark):
    q = spark.createDataFrame([(1, "red"), (2, "blue"), (3, "green")], "k long, question string")
    t = spark.createDataFrame([(1, 0, "nothing here"), (2, 0, "blue " * 600)], "k long, ordinal long, text string")
    out = {r.k: (r.context, r.n_lines, r.tokens) for r in RT.extractive_context(q, t, "k", budget=500).collect()}
    assert out == {1: ("", 0, 0), 2: ("", 0, 0), 3: ("", 0, 0)}


def test_relatedness_text(spark):
    df = spark.createDataFrame([(0.7315,), (0.1234,)], "s double")
    assert [r.t for r in df.select(RT.relatedness_text(F.col("s")).alias("t")).collect()] == ["0.732", "0.123"]


def test_relevance_gate_full_or_reduced(spark):
    best = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.1)], "qid int, rank int, similarity double")
    full = spark.createDataFrame([(1, "full-1"), (2, "full-2"), (3, "full-3")], "qid int, prompt string")
    reduced = spark.createDataFrame([(1, "small-1"), (2, "small-2"), (3, "small-3")], "qid int, prompt string")
    out = {r.qid: (r.relevant, r.context) for r in RT.relevance_gate(best, full, 0.5, reduced).collect()}
    assert out == {1: (True, "full-1"), 2: (False, "small-2"), 3: (False, "small-3")}
    blank = {r.qid: r.context for r in RT.relevance_gate(best, full, 0.5).collect()}
    assert blank[2] == ""


def _vectors(spark, rows, name, id_col):
    return spark.createDataFrame(rows, f"{id_col} long, {name} array<float>")


def test_metric_index_is_exact_and_skips(spark):
    import numpy as np

    from ledgerlens.operators import metric_index as MI
    from ledgerlens.operators import retrieval as RT
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.15).tolist()) for i in range(4000)]
    odd = [(None, rows[0][1]), (5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0]), (5003, []), (5004, [None] * 16), (5005, rows[7][1]), (5006, rows[7][1])]
    corpus = _vectors(spark, rows + odd, "embedding", "vec_id").repartition(5)
    queries = _vectors(spark, [(i, (centres[i] + rng.normal(size=16) * 0.1).tolist()) for i in range(6)] + [(6, rows[7][1])], "qvec", "qid")
    index = MI.build_metric_index(corpus, pivots=40)
    needed = MI.needed_tiles(index, queries, 20)[3]
    assert needed.mean() < 0.4  # share of (query, tile) pairs that are scored
    everything = _vectors(spark, [(8, [0.0] * 16), (9, None)], "qvec", "qid").unionByName(queries)
    for asked, k in ((queries, 1), (queries, 20), (everything, 20), (everything.limit(2), 5), (queries, 4100), (queries.limit(0), 3)):
        want = sorted(tuple(r) for r in RT.top_k_similar(corpus, asked, k).select("qid", "rank", "id", "similarity").collect())
        assert want == sorted(tuple(r) for r in MI.top_k_indexed(index, asked, k).select("qid", "rank", "id", "similarity").collect())


def test_metric_index_of_an_empty_corpus(spark):
    from ledgerlens.operators import metric_index as MI
    corpus = _vectors(spark, [(1, [1.0, 2.0])], "embedding", "vec_id")
    queries = _vectors(spark, [(1, [1.0, 0.5])], "qvec", "qid")
    assert MI.top_k_indexed(MI.build_metric_index(corpus), queries, 3).count() == 1
    assert MI.top_k_indexed(MI.build_metric_index(corpus.limit(0)), queries, 3).count() == 0
