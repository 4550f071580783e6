"""Streaming jobs. Each has a batch twin built from the same DataFrame functions.

Checkpoints live under the shared ``spark.checkpoint.dir`` (a fresh folder per
query unless one is given), so a restarted driver resumes from the last
committed batch and a lost executor only re-runs its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.routing import route_messages
from ..session import scratch_path, ship_package
from ..sources.versions import merge, publish


def route_stream(spark: SparkSession, source_dir: str, schema: T.StructType, out_path: str,
                 checkpoint: str | None = None, glob: str | None = None, prepare=None) -> None:
    """Route each arriving message (stateless, append mode) into a parquet table.

    ``prepare`` is an optional stateless transform applied to the raw stream
    before routing (the same function the batch form uses).
    """
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.parquet(source_dir)
    stream = route_messages(prepare(raw) if prepare is not None else raw)
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "ckpt-route"))
         .trigger(availableNow=True).start(out_path))
    q.awaitTermination()


def running_counts(classified: DataFrame) -> DataFrame:
    """Counts by violation type with one column per scope.

    ``pivot`` is not allowed on a stream, so the columns are conditional
    counts (0, not NULL, for an absent combination).
    """
    return classified.filter(F.col("violation_type").isNotNull()).groupBy("violation_type").agg(
        F.count_if(F.col("scope") == "local").alias("local"),
        F.count_if(F.col("scope") == "state").alias("state"))


def update_mode_to_table(stream: DataFrame, keys: list[str], out_path: str, checkpoint: str | None = None,
                         buckets: int = 256) -> None:
    """Run a streaming aggregate by ``keys`` to completion (``availableNow``), in update mode.

    A micro-batch brings the new totals of the keys it touched, which are merged into the table at ``out_path``: only
    the buckets of these keys are rewritten, so a batch costs what it changes and not what the table holds. A replayed
    batch brings the same totals and gives the same table. Read it with ``sources.versions.read_merged``.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        # the batch is read twice (buckets, rows): kept, so that its source and state are not
        batch.persist()
        try:
            merge(batch, out_path, keys, buckets)
        finally:
            batch.unpersist()

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "ckpt-counts"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


class NewestUpload(StatefulProcessor):
    """Per drop folder, the upload of the newest file seen in any batch (modification time, then folder).

    State is one row. A batch whose newest file is older changes nothing and says nothing; one that adds files to the
    newest upload, or brings a newer one, gives a row.
    """

    OUTPUT = "drop string, upload string, modified long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", "modified long, upload string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        found = max((r["modified"], r["upload"]) for r in rows)
        held = tuple(self._newest.get()) if self._newest.exists() else (-1, "")
        if found >= held or found[1] == held[1]:
            newest = max(found, held)
            self._newest.update(newest)
            yield Row(drop=key[0], upload=newest[1], modified=newest[0])

    def close(self) -> None:
        pass


#: The schema of Spark's binary files; their content is not read unless it is selected.
_FILE = "path string, modificationTime timestamp, length long, content binary"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_drop_refresh(spark: SparkSession, drop_dir: str, schema: T.StructType, analyse, out_path: str,
                      checkpoint: str | None = None, glob: str = "*.parquet", files_per_batch: int | None = None) -> None:
    """Whenever files arrive, recompute the analysis from the newest upload and replace outputs.

    An upload is a folder of any number of files under a drop folder; ``drop_dir`` may be a pattern. The stream holds
    file names and times only (no content is read), and the newest upload so far is kept as state, so that an older
    upload that reaches a later batch, or a later run of the same checkpoint, never replaces a newer one. Where the
    newest upload has changed, its folder is read as a whole and ``analyse`` of it, with the folder's name, replaces the
    table at ``out_path`` (see ``sources.versions``): an upload whose files reach two batches is complete after the
    second, and a replay gives the same table. ``out_path`` is one table: one drop folder feeds it.

    State of this kind needs the RocksDB store; the query runs in a session of its own that names it.
    """
    ship_package(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", "1")  # one state row a drop folder
    reader = own.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    files = reader.load(drop_dir).select(folder.alias("upload"), F.unix_micros("modificationTime").alias("modified"))
    newest = (files.withColumn("drop", F.regexp_extract("upload", "^(.*)/[^/]*$", 1)).groupBy("drop")
              .transformWithState(NewestUpload(), NewestUpload.OUTPUT, "Update", "None"))

    def refresh(batch: DataFrame, epoch: int) -> None:
        changed = batch.agg(F.max_by("upload", F.struct("modified", "upload")).alias("upload")).first()["upload"]
        if changed is None:
            return
        upload = spark.read.schema(schema).option("pathGlobFilter", glob).parquet(changed)
        publish(analyse(upload).withColumn("upload", F.lit(changed.rsplit("/", 1)[-1])), out_path)

    q = (newest.writeStream.outputMode("update").foreachBatch(refresh)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "ckpt-refresh"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
