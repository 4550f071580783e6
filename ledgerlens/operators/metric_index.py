"""Exact top-k by cosine over a metric index (J4, W2): most of a corpus is proved out of reach and never scored.

The index is a table partitioned by pivot. A row belongs to its nearest pivot and to a ring: a range of its angle to that
pivot. Angles between vectors obey the triangle inequality, so the angle of a query to any row of a tile (pivot, ring)
is at least the gap between the query's angle to the pivot and the tile's range of angles. The rows of a query's nearest
tiles give it a k-th best similarity; tiles whose bound is below that cannot hold any of its k best, and are skipped:
their pivots by partition pruning, their rings by a predicate on the sorted angles. The rest is scored as ever, so the
result is that of ``retrieval.top_k_similar``.

Pivots are a bounded sample (the least hashes of the ids); they decide how much is skipped, never what is found.
Vectors that are NULL, hold a NULL, have another length than the pivots or no length at all have no angle and stand in a
tile of their own (pivot -1), which is read for queries that lack k rows with a similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..session import scratch_path, ship_package
from .retrieval import SIM_DECIMALS, _arrow_type, _batches, _matrix, _top_of_tiles, cosine_scores

PIVOTS = 64
RINGS = 32
_ROWS = "id long, vec array<double>, angle double, ring int, pivot int"
#: Angles are compared with this much room for rounding.
ROOM = 1e-9
#: Bytes of query vectors that are sent to the tasks.
MAX_QUERY_BYTES = 64 << 20


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine_scores(rows, pivots), -1.0, 1.0))


class MetricIndex:
    """A written index: ``path`` of the rows (id, vec, angle, ring; folders by pivot), ``pivots``, and the tiles."""

    def __init__(self, spark: SparkSession, path: str, pivots: np.ndarray, tiles: list):
        self.spark, self.path, self.pivots = spark, path, pivots
        self.unscored = sum(t["n"] for t in tiles if t["pivot"] < 0)
        tiles = sorted((t for t in tiles if t["pivot"] >= 0), key=lambda t: (t["pivot"], t["ring"]))
        self.pivot, self.ring, self.n = (np.array([t[c] for t in tiles], np.int64) for c in ("pivot", "ring", "n"))
        self.low, self.high = (np.array([t[c] for t in tiles], float) for c in ("low", "high"))

    def rows(self, needed: np.ndarray, unscored: bool) -> DataFrame:
        """Rows of the needed tiles: pivots are pruned as folders, rings by the angles of their files."""
        wanted = F.lit(False)
        for p in np.unique(self.pivot[needed]).tolist():
            own = needed[self.pivot[needed] == p]
            wanted |= (F.col("pivot") == p) & F.col("angle").between(float(self.low[own].min()), float(self.high[own].max()))
        if unscored:
            wanted |= F.col("pivot") == -1
        return self.spark.read.schema(_ROWS).parquet(self.path).where(wanted)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, tiles): no row of a tile is more similar to a query than this."""
        theta = _angles(queries, self.pivots)[:, self.pivot]
        gap = np.maximum(np.maximum(self.low - theta, theta - self.high) - ROOM, 0.0)
        return np.where(np.isnan(theta), np.inf, np.cos(gap))


def build_metric_index(corpus: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS,
                       rings: int = RINGS, path: str | None = None) -> MetricIndex:
    """Write the index of ``corpus``; rows without an id are left out, as by ``similarity_candidates``."""
    spark = corpus.sparkSession
    ship_package(spark)
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL")
    sample = rows.where(F.size("vec") > 0).orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow()
    dims = max(sample.column("vec").combine_chunks().value_lengths().to_pylist(), default=1)
    middle = _matrix(sample.column("vec"), dims)
    middle = middle[np.isfinite(middle).all(axis=1) & (np.abs(middle).max(axis=1, initial=0) > 0)]
    sent = spark.sparkContext.broadcast(middle)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle = _angles(_matrix(b.column(1), dims), sent.value) if len(sent.value) else np.full((b.num_rows, 1), np.nan)
            none = np.isnan(angle).any(axis=1)
            angle[none] = 0.0
            pivot = np.where(none, -1, angle.argmin(axis=1))
            own = angle.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(own), pa.array(np.minimum(own / np.pi * rings, rings - 1).astype(np.int32)),
                 pa.array(pivot.astype(np.int32))], names=["id", "vec", "angle", "ring", "pivot"])

    path = path or scratch_path(spark, "metric_index")
    placed = rows.mapInArrow(place, _ROWS)
    # a pivot's rows go to tasks by ring as well, so that a pivot near a third of all rows is not one task's
    (placed.repartition("pivot", "ring").sortWithinPartitions("pivot", "angle").write.partitionBy("pivot").parquet(path))
    tiles = (spark.read.schema(_ROWS).parquet(path).groupBy("pivot", "ring")
             .agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect())
    return MetricIndex(spark, path, middle, tiles)


def _score(index: MetricIndex, needed: np.ndarray, unscored: np.ndarray, vectors: np.ndarray, qids: list, qid_type, k: int) -> DataFrame:
    """(qid, id, similarity) of the k best rows of each task per query, over the tiles that the query needs."""
    number = {(p, r): i for i, (p, r) in enumerate(zip(index.pivot.tolist(), index.ring.tolist()))}
    sent = index.spark.sparkContext.broadcast((needed, unscored, number, vectors, qids))
    dims, kind = vectors.shape[1], _arrow_type(qid_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed, unscored, number, vectors, qids = sent.value
        for b in batches:
            rows, ids = _matrix(b.column(1), dims), b.column(0).to_numpy()
            tile = np.array([number.get(x, -1) for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], np.int64)
            for t in np.unique(tile).tolist():
                own = np.flatnonzero(needed[:, t] if t >= 0 else unscored)
                if len(own):
                    yield from _batches(_top_of_tiles(rows[tile == t], ids[tile == t], vectors[own], k, cosine_scores),
                                        [qids[i] for i in own.tolist()], kind)

    schema = T.StructType([T.StructField("qid", qid_type), T.StructField("id", T.LongType()), T.StructField("similarity", T.DoubleType())])
    rows = index.rows(np.flatnonzero(needed.any(axis=0)), bool(unscored.any()))
    return rows.select("id", "vec", "pivot", "ring").mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("similarity").desc_nulls_last(), F.col("id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def needed_tiles(index: MetricIndex, queries: DataFrame, k: int, query_id: str = "qid", query_vec: str = "qvec"):
    """(qids, their type, vectors, needed (queries, tiles), unscored (queries)): what has to be scored for exact results."""
    held = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).cast("array<double>").alias("qvec"))
    kind = held.schema["qid"].dataType
    if (held.agg(F.sum(8 * F.size("qvec"))).first()[0] or 0) > MAX_QUERY_BYTES:
        raise ValueError("cut the queries in blocks: the index is asked by a bounded number of them at a time")
    table = held.toArrow()
    qids, vectors = table.column("qid").to_pylist(), _matrix(table.column("qvec"), index.pivots.shape[1])
    bounds = index.bounds(vectors)
    # the tiles of the best bounds that hold k rows together
    order = np.argsort(-bounds, axis=1, kind="stable")
    seed = np.zeros(bounds.shape, bool)
    np.put_along_axis(seed, order, np.cumsum(index.n[order], axis=1) - index.n[order] < k, axis=1)
    none = np.zeros(len(qids), bool)
    first = _ranked(_score(index, seed, none, vectors, qids, kind, k), k).where(F.col("rank") == k).select("qid", "similarity")
    kth = {r["qid"]: r["similarity"] for r in first.collect()}
    least = np.array([-np.inf if kth.get(q) is None else kth[q] for q in qids])
    return qids, kind, vectors, bounds >= least[:, None] - ROOM, least == -np.inf


def top_k_indexed(index: MetricIndex, queries: DataFrame, k: int, query_id: str = "qid", query_vec: str = "qvec") -> DataFrame:
    """(qid, id, similarity, rank) as ``retrieval.top_k_similar`` of the indexed corpus: exact, with skipped tiles."""
    qids, kind, vectors, needed, unscored = needed_tiles(index, queries, k, query_id, query_vec)
    found = _score(index, needed, unscored, vectors, qids, kind, k)
    return _ranked(found, k).withColumn("similarity", F.round("similarity", SIM_DECIMALS))
