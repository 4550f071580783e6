"""The pipeline against a brute-force version on planted documents, and the entry point's registration."""

import collections

import corpus_pipeline
from ledgerlens.llm import packing, simhash

from .test_small_cases import brute_best, brute_components, brute_lines, prose


def test_pipeline_equals_brute_force(spark, make_docs, tmp_path):
    items = [(1, prose(901, 30)), (2, prose(902, 17))]
    docs = [(i, f"shared banner line\n{prose(i, 80)}") for i in range(14)]
    docs += [(20, prose(20, 40)), (21, prose(20, 40)), (22, prose(1, 80)), (23, None), (24, "12 34 !!"), (25, ""),
             (26, prose(30, 50) + " " + prose(901, 30)), (27, prose(31, 5) + "\n" + prose(902, 17)), (28, "x")]
    make_docs(docs, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    left = [(d, t) for (d, _, _, t), n in brute_lines(left, 10).items() for _ in range(n)]
    names = {c for _, _, c in brute_components(left)}
    left = [d for d in left if d[0] in names]
    leaks = {d for d, _ in brute_best(left, items)}
    left = {d: t for d, t in left if d not in leaks}
    assert {26, 27} <= leaks and 21 not in left and 22 not in left

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    docs_now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = stage(spark, docs_now, str(tmp_path))
        assert docs_now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs_now.write.parquet(f"{tmp_path}/{name}")
        docs_now = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id: r.text for r in docs_now.collect()} == left

    encode, got = packing.token_encoder(), collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == {d: len(encode(t)) // 4 + 1 for d, t in left.items()}


def test_near_duplicates_keep_clean_documents(make_docs):
    docs = [(i, prose(i, 60)) for i in range(30)]
    assert simhash.keep_one(make_docs(docs)).count() == 30


def test_entry_point_registers_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
