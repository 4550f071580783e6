"""Tables that are replaced as a whole, by versions.

A table is a folder with one sub-folder per version and, in ``_commits``, one empty file per committed version, whose
name holds a growing number and the version's folder. A writer fills a new folder and only then creates that file, which
is one atomic step on any file system; a reader takes the version of the greatest number. So a reader never meets a
half-written table, a write that fails changes nothing, and a job may replace the table that it reads.

``merge`` keeps a table of one row per key in hash buckets of its keys. A version of such a table holds only the buckets
that its merge touched, and a reader takes each bucket from the newest committed version that has it.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_COMMITS = "_commits"
_BUCKET = "_bucket"
#: Committed versions that stay on disk: the current one, and one for readers that have just opened it.
KEPT_VERSIONS = 2


def _folder(spark: SparkSession, path: str):
    """Hadoop path and file system of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the committed versions of a table, oldest first; none if there is no such table."""
    at, fs = _folder(spark, f"{path.rstrip('/')}/{_COMMITS}")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n[:1].isdigit())


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the table's current version, None before the first commit."""
    known = committed(spark, path)
    return f"{path.rstrip('/')}/{known[-1][1]}" if known else None


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as the table's next version and make it the current one; returns its folder.

    A failed write leaves the table as it was. Of two writers at once the later commit wins (equal numbers: by the
    version's name), and neither sees the other's files.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    at, fs = _folder(spark, f"{path}/{version}")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    try:
        writer.parquet(f"{path}/{version}")
    except Exception:
        fs.delete(at, True)
        raise
    known = _commit(spark, path, version)
    for old, name in known[:1 - KEPT_VERSIONS]:
        _forget(spark, path, old, name)
    return f"{path}/{version}"


def publish_with_totals(df: DataFrame, path: str, totals: list[Column]) -> DataFrame:
    """``publish`` and, from the same pass over ``df``, one row of ``totals`` (aggregates of its columns).

    The totals are observed while the rows are written: each task's part counts once, however often the task was tried,
    as no shuffle follows. Without rows they are what the aggregates give for an empty table. Names must differ.
    """
    seen = Observation()
    schema = df.agg(*totals).schema
    publish(df.observe(seen, *totals), path)
    got = seen.get
    return df.sparkSession.createDataFrame([tuple(got[f.name] for f in schema.fields)], schema)


def _commit(spark: SparkSession, path: str, version: str) -> list[tuple[int, str]]:
    """Make a written version the current one; returns the versions committed before it."""
    known = committed(spark, path)
    number = known[-1][0] + 1 if known else 1
    at, fs = _folder(spark, f"{path}/{_COMMITS}/{number:020d}-{version}")
    fs.create(at, False).close()
    return known


def _forget(spark: SparkSession, path: str, number: int, version: str) -> None:
    """Delete a committed version: first its commit, so that no reader takes it up, then its files."""
    for gone in (f"{path}/{_COMMITS}/{number:020d}-{version}", f"{path}/{version}"):
        at, fs = _folder(spark, gone)
        fs.delete(at, True)


def _buckets_of(spark: SparkSession, path: str, version: str) -> list[int]:
    """Buckets that a version of a merged table holds."""
    at, fs = _folder(spark, f"{path}/{version}")
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return [int(n.split("=", 1)[1]) for n in names if n.startswith(f"{_BUCKET}=")]


def current_buckets(spark: SparkSession, path: str) -> dict[int, str]:
    """Bucket -> the newest committed version that holds it, of a table written by ``merge``."""
    return {b: v for _, v in committed(spark, path) for b in _buckets_of(spark, path.rstrip("/"), v)}


def _fixed_buckets(spark: SparkSession, path: str, keys: list[str], buckets: int) -> None:
    """Note keys and bucket count with the table's first merge; later merges must name the same."""
    mark = f"buckets-{buckets}-{'-'.join(quote(k, safe='') for k in keys)}"
    at, fs = _folder(spark, f"{path}/{_COMMITS}")
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    marks = [n for n in found if n.startswith("buckets-")]
    if marks and marks != [mark]:
        raise ValueError(f"the table at {path} was built as {marks[0]}, not {mark}")
    if found and not marks:
        raise ValueError(f"the table at {path} is replaced as a whole, so nothing can be merged into it")
    if not marks:
        fs.create(_folder(spark, f"{path}/{_COMMITS}/{mark}")[0], False).close()


def merge(changed: DataFrame, path: str, keys: list[str], buckets: int = 256) -> None:
    """Upsert ``changed``, one row per key, into the table at ``path``; its rows replace those of equal keys.

    Only the buckets with a changed key are read and written, as one version with one commit step: a merge that fails
    changes nothing, and one that is repeated gives the same table. The columns must stay the same. A NULL in a key is a
    value. Repeated keys in ``changed``: one of their rows stays. No rows: nothing is written. One writer at a time: a
    merge builds on the buckets that are current when it starts. Versions of which no bucket is current are deleted, but
    for the newest that became so, for readers that have just opened it; at most ``buckets`` + 1 of them remain.
    """
    spark, path = changed.sparkSession, path.rstrip("/")
    _fixed_buckets(spark, path, keys, buckets)
    placed = changed.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = [r[_BUCKET] for r in placed.select(_BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    held = current_buckets(spark, path)
    rows = placed.withColumn("_new", F.lit(1))
    old = [f"{path}/{held[b]}/{_BUCKET}={b}" for b in touched if b in held]
    if old:
        rows = (spark.read.schema(changed.schema).parquet(*old)
                .withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
                .withColumn("_new", F.lit(0)).unionByName(rows))
    # one shuffle, by bucket, serves the choice of rows and leaves one file a bucket
    newest = (rows.repartition(_BUCKET).groupBy(_BUCKET, *keys)
              .agg(F.max_by(F.struct(*changed.columns), "_new").alias("_row")))
    merged = newest.select(_BUCKET, "_row.*")
    version = f"v-{uuid.uuid4().hex}"
    at, fs = _folder(spark, f"{path}/{version}")
    try:
        merged.write.partitionBy(_BUCKET).parquet(f"{path}/{version}")
    except Exception:
        fs.delete(at, True)
        raise
    known = _commit(spark, path, version)
    live = set(current_buckets(spark, path).values())
    was_live = set(held.values())
    for number, name in known:
        if name not in live and name not in was_live:
            _forget(spark, path, number, name)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table written by ``merge``, as of now."""
    path, held = path.rstrip("/"), current_buckets(spark, path)
    if not held:
        raise FileNotFoundError(f"no committed version of a table at {path}")
    return spark.read.parquet(*[f"{path}/{v}/{_BUCKET}={b}" for b, v in sorted(held.items())])


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table's current version."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no committed version of a table at {path}")
    return spark.read.parquet(version)
