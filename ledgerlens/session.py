"""Session helpers: a local session for tests and the shared scratch folder.

On a cluster the session is created by the caller; nothing here changes its
configuration except filling ``spark.checkpoint.dir`` when it is unset, which
only happens in local runs.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def local_session(cores: str = "8", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a ``local[cores]`` session configured for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerlens")
    for k, v in {**_LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    A folder on this machine is chosen only when none is configured *and* the master is local; on a
    cluster every executor would write to its own disk, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = os.path.join("/tmp", "ledgerlens-checkpoints")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for intermediate tables and files."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerlens/{name}-{uuid.uuid4().hex[:12]}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared scratch folder and read back.

    Its plan is cut there, and the planner knows the size of the files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when their results have been read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Tables of at most this many bytes are broadcast; larger ones are joined as the planner sees fit.
MAX_BROADCAST_BYTES = 8 << 20


def broadcast_checked(df: DataFrame, size_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its measured size is small, else as it is."""
    return F.broadcast(df) if size_bytes <= MAX_BROADCAST_BYTES else df


def param_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A parameter table from literal rows (rules, fines, prices), whose size is known when it is built."""
    return broadcast_checked(spark.createDataFrame(rows, schema), sum(len(repr(r)) for r in rows))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (like ``--py-files``).

    Arrow/pandas kernels are pickled by reference to their module, so every
    executor needs ``ledgerlens`` on its path. The package (Python sources
    only, a few hundred KB) is zipped once per application and registered with
    ``addPyFile``, which ships it to every executor; a copy already installed
    on the executors is simply shadowed by the same code.
    """
    import tempfile
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-pyfiles-"), "ledgerlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, dirs, files in os.walk(pkg_dir):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("ledgerlens", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
