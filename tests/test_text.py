import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import text as TX
from ledgerlens.session import scratch_path
from ledgerlens.sources import files as FS
from ledgerlens.sources import versions
from ledgerlens.sources.sheets import read_sheets


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first().o


def test_clean_text_fixture(spark):
    src = "see http://a http://a/b, ok? a\nb      c"
    assert _one(spark, src, TX.clean_text) == "see http://a http://a/b, ok ab c"


def test_clean_text_keeps_every_url(spark):
    urls = ["https://x.example.com/p?q=1&r=(2)", "http://a.b/c#frag", "http://x/y.z,"]
    src = "Links: " + " ; ".join(urls) + " -- end!"
    out = _one(spark, src, TX.clean_text)
    assert "https://x.example.com/p?q=1&r=(2)" in out and "http://a.b/c" in out and "http://x/y.z," in out
    assert "#" not in out and ";" not in out and "!" not in out


def test_clean_text_unicode_word_chars(spark):
    assert _one(spark, "é_1 ½ – ü!", TX.clean_text) == "é_1 ½  ü"


def test_token_count_additive(spark):
    a, b = "Hello, world!", "It's 3.5 o'clock."
    na, nb = _one(spark, a, TX.token_count), _one(spark, b, TX.token_count)
    assert _one(spark, a + "\n" + b, TX.token_count) == na + nb
    assert na == 4 and _one(spark, None, TX.token_count) == 0


def test_money_and_row_text(spark):
    assert _one(spark, "1234.5", lambda c: TX.money(c.cast("double"))) == "$1,234.50"
    df = spark.createDataFrame([(1, None, 2.5)], "a int, b string, c double")
    assert df.select(TX.row_text("a", "b", "c").alias("o")).first().o == "1 2.5"


def test_period_months(spark):
    assert _one(spark, "August 2017 to August 2018", TX.period_months) == 13
    assert _one(spark, "August 2017 to August 2018", lambda c: TX.period_months(c, inclusive=False)) == 12
    assert _one(spark, "no dates here", TX.period_months) is None


def test_vector_csv_roundtrip(spark):
    rows = [(1, 'He said "hi", then\nleft', [0.25, -1.5, 3.0]), (2, "plain", [1e-9, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, text string, embedding array<double>")
    path = scratch_path(spark, "test_csv")
    FS.write_vector_csv(df, path)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("embedding", T.StringType())])
    back = sorted(FS.read_vector_csv(spark, path, schema).collect())
    assert [tuple(r) for r in back] == rows


def test_malformed_vector_is_null(spark):
    assert _one(spark, "[1.0, oops", FS.parse_vector) is None


def test_vector_csv_keeps_spaces_empty_and_missing_texts(spark):
    rows = [(1, " lead", [1.0]), (2, "trail  ", [2.0]), (3, "", [3.0]), (4, None, [4.0]), (5, 'a,"b"\nc', None)]
    schema = "k long, text string, embedding array<double>"
    path = scratch_path(spark, "faithful")
    df = spark.createDataFrame(rows, schema)
    FS.write_vector_csv(df, path)
    back = FS.read_vector_csv(spark, path, df.schema).orderBy("k").collect()
    assert [tuple(r) for r in back] == rows


def test_spoilt_vectors_are_kept_apart(spark):
    text = spark.createDataFrame([(1, " a ", "[1.0,2]"), (2, "b", "[1.0, oops"), (3, "c", None), (4, "", "[1,null]"),
                                  (5, None, "text"), (6, "f", "[]")], "k long, t string, embedding string")
    path = scratch_path(spark, "test_csv")
    text.write.options(**FS._FAITHFUL, emptyValue='""').csv(path)
    schema = T.StructType().add("k", "long").add("t", "string").add("embedding", T.ArrayType(T.DoubleType()))
    rows, spoilt = FS.read_vector_csv_checked(spark, path, schema)
    assert rows.columns == schema.names
    assert sorted(map(tuple, rows.collect())) == [(1, " a ", [1.0, 2.0]), (3, "c", None), (6, "f", [])]
    assert sorted(map(tuple, spoilt.collect())) == [(2, "b", "[1.0, oops"), (4, "", "[1,null]"), (5, None, "text")]


SHEET = T.StructType().add("k", "long").add("name", "string").add("amount", "double").add("spoilt", "string")


def test_spoilt_lines_are_kept_apart_as_they_stand(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'k,name,amount,spoilt\n1,"x, ""y""",2.5,p\n2,short\n\n3,z,n/a,p\n4,z,1,p,more\n5,,,\n6,"open,1,p\n7,last,3,p\n')
    (tmp_path / "b.csv").write_text("k,name,amount,spoilt\nnine,z,1,p\n8,z,1,p\n8,z,1,p\n")
    (tmp_path / "c.csv").write_text("k,name,amount,spoilt\n")
    rows, spoilt = FS.read_csv_checked(spark, str(tmp_path), SHEET)
    assert rows.schema.simpleString() == SHEET.simpleString()
    assert sorted(map(tuple, rows.collect()), key=str) == [
        (1, 'x, "y"', 2.5, "p"), (5, None, None, None), (7, "last", 3.0, "p"), (8, "z", 1.0, "p"), (8, "z", 1.0, "p")]
    assert sorted((r.spoilt_line, r.source_file[-5:]) for r in spoilt.collect()) == [
        ("2,short", "a.csv"), ("3,z,n/a,p", "a.csv"), ("4,z,1,p,more", "a.csv"), ('6,"open,1,p', "a.csv"),
        ("nine,z,1,p", "b.csv")]
    assert spoilt.count() == 5 and rows.select("name").count() == 5  # neither needs the other's columns


def test_sheet_without_lines_has_neither(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,name,amount,spoilt\n")
    rows, spoilt = FS.read_csv_checked(spark, str(tmp_path), SHEET)
    assert rows.columns == SHEET.names and rows.count() == 0 and spoilt.count() == 0


def test_lines_in_quotes_may_span_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,name,amount,spoilt\n1,"two\nlines",2,p\n2,x,no,p\n')
    rows, spoilt = FS.read_csv_checked(spark, str(tmp_path), SHEET, multi_line=True)
    assert [tuple(r) for r in rows.collect()] == [(1, "two\nlines", 2.0, "p")] and spoilt.count() == 1


def test_money_null_stays_null(spark):
    assert _one(spark, None, lambda c: TX.money(c.cast("double"))) is None


def test_checkpoint_folder_must_be_shared_off_local_masters():
    import pytest

    from ledgerlens.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def _sheets(folder, files):
    for name, text in files.items():
        os.makedirs(folder / name)
        (folder / name / "part 1.csv").write_text(text)
    return str(folder)


def test_sheets_have_the_columns_of_all_headers(spark, tmp_path):
    path = _sheets(tmp_path, {"a": "banner\nx,y\n1,2\n", "b": 'ban,"n\ner"\ny,x\n"4\nlines",3\n\n6,5,7\n',
                              "c": "banner\nx\n7\n", "d": "banner\nonly last,x,x\n,8,9\n\"\"\n", "e": "banner\n", "f": ""})
    out = read_sheets(spark, path)
    assert out.columns == ["source_file", "ordinal", "x", "y", "only last"]
    got = [tuple(r)[1:] for r in out.orderBy("source_file", "ordinal").collect()]
    assert got == [(0, "1", "2", None), (0, "3", "4\nlines", None), (2, "5", "6", None), (0, "7", None, None),
                   (0, "8", None, None), (1, None, None, "")]
    assert [tuple(r) for r in read_sheets(spark, path, columns=["y", "z"]).select("y", "z").where("y = '2'").collect()] == [("2", None)]


def test_sheets_of_folders_with_keys_and_none(spark, tmp_path):
    path = _sheets(tmp_path / "x", {"_part=1": "banner\na\n1\n", "_temporary": "banner\nb\n2\n", ".c": "banner\nc\n3\n"})
    assert [tuple(r)[1:] for r in read_sheets(spark, path).collect()] == [(0, "1")]
    (tmp_path / "none").mkdir()
    assert read_sheets(spark, str(tmp_path / "none")).count() == 0


def test_sheets_are_streamed(spark, tmp_path):
    rows = 60_000
    path = _sheets(tmp_path, {"a": "Banner line\nname,value\n" + "".join(f'"n{i}, with comma",{i}\n' for i in range(rows))})
    out = read_sheets(spark, path)
    assert out.rdd.getNumPartitions() == 1
    r = out.selectExpr("count(*) AS n", "sum(value) AS s", "max(ordinal) AS m", "count_if(name <> concat('n', value, ', with comma')) AS bad").first()
    assert (r.n, r.s, r.m, r.bad) == (rows, rows * (rows - 1) / 2, rows - 1, 0)


def test_parse_timestamp_strict_and_quarantine(spark):
    import pytest
    df = spark.createDataFrame([("2020-01-31",), ("not a date",)], "t string")
    soft = [r.o for r in df.select(TX.parse_timestamp(F.col("t"), strict=False).alias("o")).collect()]
    assert soft[0] is not None and soft[1] is None
    with pytest.raises(Exception):
        df.select(TX.parse_timestamp(F.col("t")).alias("o")).collect()


def test_int_from_text(spark):
    assert _one(spark, " 13 ", TX.int_from_text) == 13


def test_write_results(spark):
    base = scratch_path(spark, "results")
    paths = FS.write_results({"a": spark.range(3), "b": spark.range(5)}, base)
    assert FS.read_current(spark, paths["a"]).count() == 3 and FS.read_current(spark, paths["b"]).count() == 5


def test_a_write_that_fails_midway_changes_nothing(spark):
    import pytest

    path = scratch_path(spark, "versions")
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") < 99, F.col("id")).otherwise(
        F.raise_error(F.lit("midway"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="midway"):
        FS.build_once(spark, path, lambda: bad)
    assert not FS.table_exists(spark, path)  # a failed build is not a table
    assert FS.build_once(spark, path, lambda: spark.range(7)).count() == 7
    reader = FS.read_current(spark, path)
    with pytest.raises(Exception, match="midway"):
        FS.replace_table(bad, path)
    assert FS.read_current(spark, path).count() == 7
    FS.replace_table(FS.read_current(spark, path).where("id < 5"), path)  # a table replaced by a query of itself
    assert FS.read_current(spark, path).count() == 5 and reader.count() == 7  # who has it open reads on
    FS.replace_table(spark.range(2), path)
    assert [n for n, _ in versions.committed(spark, path)] == [2, 3] and FS.read_current(spark, path).count() == 2
