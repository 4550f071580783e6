from pyspark.sql import functions as F

from ledgerlens.operators.routing import route_messages
from ledgerlens.session import scratch_path
from ledgerlens.sources.files import read_current
from ledgerlens.sources.versions import committed, current_buckets, current_version, merge, publish, read_merged
from ledgerlens.sources.tables import SCHEMAS, read_table
from ledgerlens.streaming import streams as ST
from ledgerlens.plans import app_queries as AQ


def test_route_stream_equals_batch(spark, sf_dir):
    out = scratch_path(spark, "route_out")
    ST.route_stream(spark, sf_dir, SCHEMAS["conversations"], out, glob="conversations.parquet")
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select("conv_id", "turn", "route", "command").collect())
    batch = sorted(tuple(r) for r in route_messages(read_table(spark, sf_dir, "conversations"))
                   .select("conv_id", "turn", "route", "command").collect())
    assert streamed == batch and len(batch) > 0


def test_route_messages_stream_reads_a_folder_of_files(spark):
    d = scratch_path(spark, "conv_parts")
    rows = [(c, t, "user", None if t == 3 else f"/go{c} now" if t == 2 else "hello") for c in range(5) for t in range(9)]
    for part in (rows, [(None, 0, None, "x"), (9, None, "user", None)]):
        (spark.createDataFrame(part, SCHEMAS["conversations"]).repartition(3).write.mode("append")
         .parquet(f"{d}/conversations.parquet"))
    spark.createDataFrame([(1, "x", "y")], SCHEMAS["pages"]).write.parquet(f"{d}/pages.parquet")  # another table
    got = AQ.route_messages_stream(spark, d)
    want = AQ.route_messages_q(spark, d)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == len(rows) + 2


def test_route_messages_stream_without_files_gives_no_rows(spark, tmp_path):
    (tmp_path / "conversations.parquet").mkdir()
    assert AQ.route_messages_stream(spark, str(tmp_path)).collect() == []


def test_stream_counts_equal_batch(spark, sf_dir):
    from ledgerlens.plans import citation_queries as CQ
    streamed = {r.violation_type: (r.local, r.state) for r in AQ.stream_counts(spark, sf_dir).collect()}
    batch = {r.violation_type: (r.local or 0, r.state or 0)
             for r in CQ.citations_by_type_scope(spark, sf_dir).collect()}
    assert streamed == batch


def _stream_of_files(spark, path, batches):
    """One parquet file per batch, each of (k, v) rows; read one file at a time, oldest first."""
    import glob
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(path)
        for f in set(glob.glob(f"{path.removeprefix('file:')}/*.parquet")) - _SEEN:
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
            _SEEN.add(f)
    stream = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(path)
    return stream.groupBy("k").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))


_SEEN: set[str] = set()


def test_update_mode_rewrites_only_the_buckets_of_touched_keys(spark):
    src, out, ckpt = (scratch_path(spark, n) for n in ("src", "merged", "ckpt"))
    first = [(f"k{i}", 1) for i in range(60)] + [(None, 5), ("k0", 2)]
    counts = _stream_of_files(spark, src, [first])
    ST.update_mode_to_table(counts, ["k"], out, ckpt, buckets=64)
    before = current_buckets(spark, out)
    counts = _stream_of_files(spark, src, [[("k1", 10), (None, 7)], [("k1", 100), ("new", 1)]])
    ST.update_mode_to_table(counts, ["k"], out, ckpt, buckets=64)
    after = current_buckets(spark, out)
    place = {r.k: r.b for r in spark.createDataFrame([("k1",), (None,), ("new",)], "k string").select(
        "k", F.pmod(F.xxhash64("k"), F.lit(64)).alias("b")).collect()}
    assert {b for b in after if after[b] != before.get(b)} == set(place.values())
    want = {f"k{i}": (1, 1) for i in range(60)} | {"k0": (3, 2), "k1": (111, 3), None: (12, 2), "new": (1, 1)}
    got = read_merged(spark, out).collect()
    assert {r.k: (r.v, r.n) for r in got} == want and len(got) == len(want)
    again = current_buckets(spark, out)
    ST.update_mode_to_table(counts, ["k"], out, ckpt, buckets=64)  # nothing new arrives: nothing is written
    assert current_buckets(spark, out) == again


def test_merge_repeated_failed_empty_and_at_other_buckets(spark):
    import pytest

    out = scratch_path(spark, "merged")
    rows = lambda *r: spark.createDataFrame(list(r), "a string, b long, v long")
    merge(rows(("x", 1, 1), ("x", None, 2), (None, None, 3)), out, ["a", "b"], 4)
    merge(rows(("x", None, 20), ("y", 1, 4)), out, ["a", "b"], 4)
    merge(rows(("x", None, 20), ("y", 1, 4)), out, ["a", "b"], 4)  # a replay
    want = [("None", "None", 3), ("x", "1", 1), ("x", "None", 20), ("y", "1", 4)]
    table = lambda: sorted((str(r.a), str(r.b), r.v) for r in read_merged(spark, out).collect())
    assert table() == want
    held, folders = current_buckets(spark, out), len(committed(spark, out))
    with pytest.raises(Exception, match="spoilt"):
        merge(rows(("x", 1, 9)).withColumn("v", F.raise_error(F.lit("spoilt")).cast("long")), out, ["a", "b"], 4)
    merge(rows(), out, ["a", "b"], 4)
    assert current_buckets(spark, out) == held and len(committed(spark, out)) == folders and table() == want
    with pytest.raises(ValueError, match="buckets-4-a-b"):
        merge(rows(("z", 1, 1)), out, ["a", "b"], 8)
    plain = scratch_path(spark, "plain")
    publish(rows(("x", 1, 1)), plain)
    with pytest.raises(ValueError, match="replaced as a whole"):
        merge(rows(("x", 1, 1)), plain, ["a", "b"], 4)
    for v in range(12):  # versions that hold no current bucket go
        merge(rows(("x", 1, v)), out, ["a", "b"], 4)
    assert len(committed(spark, out)) <= 5 and ("x", "1", 11) in table() and len(table()) == 4


def test_file_drop_refresh_uses_newest_upload(spark, sf_dir):
    from ledgerlens.plans import citation_queries as CQ
    rows = AQ.file_drop_refresh(spark, sf_dir).collect()
    assert sorted(map(str, rows)) == sorted(map(str, CQ.citations_by_type_scope(spark, sf_dir).collect()))


def _counts(df):
    return df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def _drop(spark, path, value, rows, at, parts=1):
    """An upload of ``rows`` rows whose files have the modification time ``at``."""
    import glob
    import os

    spark.createDataFrame([(i, value) for i in range(rows)], "k long, v string").repartition(parts).write.parquet(path)
    for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet"):
        os.utime(f, (at, at))


def _refreshed(spark, drop, out, ckpt, **kw):
    schema = spark.createDataFrame([], "k long, v string").schema
    ST.file_drop_refresh(spark, f"{drop}/*", schema, _counts, out, ckpt, **kw)
    return [(r.v, r.n, r.upload) for r in read_current(spark, out).collect()]


def test_file_drop_refresh_across_runs(spark):
    drop, ckpt, out = (scratch_path(spark, n) for n in ("drop", "ckpt", "out"))
    _drop(spark, f"{drop}/u1", "a", 2, 1_000_000)
    assert _refreshed(spark, drop, out, ckpt) == [("a", 2, "u1")]
    _drop(spark, f"{drop}/u2", "b", 1000, 2_000_000, parts=4)
    assert _refreshed(spark, drop, out, ckpt) == [("b", 1000, "u2")]  # only the new upload, all four files of it
    assert _refreshed(spark, drop, out, ckpt) == [("b", 1000, "u2")]  # nothing new: unchanged


def test_an_older_upload_in_a_later_batch_changes_nothing(spark):
    drop, ckpt, out = (scratch_path(spark, n) for n in ("drop", "ckpt", "out"))
    _drop(spark, f"{drop}/new er", "b", 5, 2_000_000)  # a folder name with a space
    assert _refreshed(spark, drop, out, ckpt) == [("b", 5, "new er")]
    first = current_version(spark, out)
    _drop(spark, f"{drop}/older", "a", 7, 1_000_000)
    assert _refreshed(spark, drop, out, ckpt) == [("b", 5, "new er")] and current_version(spark, out) == first
    _drop(spark, f"{drop}/newest", "c", 3, 3_000_000)
    assert _refreshed(spark, drop, out, ckpt) == [("c", 3, "newest")]


def test_batches_of_one_file_end_with_the_newest_upload(spark):
    drop, ckpt, out = (scratch_path(spark, n) for n in ("drop", "ckpt", "out"))
    _drop(spark, f"{drop}/u2", "b", 40, 2_000_000, parts=3)
    _drop(spark, f"{drop}/u1", "a", 9, 1_000_000, parts=2)
    assert _refreshed(spark, drop, out, ckpt, files_per_batch=1) == [("b", 40, "u2")]
