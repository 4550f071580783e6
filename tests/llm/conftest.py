import pytest

from ledgerlens.session import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, lang[, source]]), over several partitions, with columns of clashing names."""
    ship_package(spark)

    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0",
                 None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if clash:
            for c in ("_doc", "_text_hash", "line", "pos", "key", "h1", "fp", "row", "owner", "range", "dropped", "size",
                      "block", "u", "node", "found"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make


