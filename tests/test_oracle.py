"""Every registered query with oracle SQL equals DuckDB's result on the smoke tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if not n.startswith("op")))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = E.queries()[name](spark, sf_dir)
    cols = df.columns
    got = sorted((tuple(_norm(v) for v in r) for r in df.collect()), key=_key)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=_key)
    assert got == want


def test_queries_without_oracle_are_known():
    """SQL has no hashing embedding; its registered query is checked below, the numbered ones in their own tests."""
    numbered = {n for n in E.queries() if n == "pipeline" or n.startswith("op")}
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(E.queries()) - set(E.oracle_sql()) - numbered == {"embed_batch"}


def test_embed_batch_gives_every_document_a_unit_vector(spark, sf_dir):
    rows = E.queries()["embed_batch"](spark, sf_dir).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["violation_type", "local", "state"] and df.count() > 0


def test_same_result_at_one_and_many_partitions(spark, sf_dir):
    names = ["violation_metrics", "union_renumber", "cosine_topk", "extractive_context"]
    before = {n: sorted(map(tuple, E.queries()[n](spark, sf_dir).collect()), key=_key) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        after = {n: sorted(map(tuple, E.queries()[n](spark, sf_dir).collect()), key=_key) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert before == after
