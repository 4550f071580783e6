"""Hard negatives by exact integer inner products, several candidates in one multiplication.

Kronecker packing: the components of ``k`` candidates are biased so that none is negative and put in ``k`` separated
fields of one wide integer per dimension. One multiplication per (biased) anchor component then adds to all ``k`` inner
products at once; as no field can overflow into the next, masking unpacks them exactly, and the biases are taken off
again. Where two fields or more fit in 53 bits the wide integers are held in doubles, whose sums of whole numbers
below 2^53 are exact in any order, so that a matrix product does the work; larger numbers take Python's integers of
any width. Fields are as wide as the numbers at hand need.

The anchors are a stated query set, scored against all rows in blocks: a block of at most ``block_bytes`` of anchors is
sent to the tasks, which read the rows where they are and keep, per anchor, the best few only. A first pass finds the
positives, a second one the negatives in the score ranges that the positives set. Each block's results are written.

Cases: rows with a NULL label, a NULL vector, or a NULL or non-finite component take no part. Vectors are compared with
vectors of their own length only (of length 0: score 0). A NULL ``vec_id`` is never an anchor, keeps its label, and
comes last among ties. Repeated rows count one by one: a copy of an anchor is another row, and a repeated anchor returns
its rows once per copy. A score beyond a long is held at the nearest long. An anchor without positives, and a pair
without a negative in range, returns no row; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ship_package
from .common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these hundredths of its positive's score.
LEAST_SHARE, MOST_SHARE = 50, 95
#: Anchors sent to the tasks at once: bytes of their whole-number components.
BLOCK_BYTES = 16 << 20
#: Scores computed at once.
TILE = 1 << 21
#: Whole numbers up to here are exact in a double.
DOUBLE_BITS = 53
#: Fields of a Python integer.
WIDE_FIELDS = 32

_LONG = (1 << 63) - 1


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): longs where all fit in 53 bits, else Python integers."""
    y = np.floor(SCALE * x)
    if not y.size or np.abs(y).max() < 2.0 ** DOUBLE_BITS:
        return y.astype(np.int64)
    return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products (m, n) of whole-number rows (m, d) and (n, d), by Kronecker packing."""
    (m, d), n = anchors.shape, len(candidates)
    if not (m and n and d):
        return np.zeros((m, n), np.int64)
    low_a, low_c = int(anchors.min()), int(candidates.min())
    a, c = anchors - low_a, candidates - low_c
    if max(int(a.max()), int(c.max())) * d >= 1 << 62:
        a, c = a.astype(object), c.astype(object)
    # no sum of a field exceeds an anchor's components times the greatest candidate component of each dimension
    greatest = c.max(axis=0)
    if a.dtype == object or c.dtype == object or int(a.max()) * int(greatest.max()) * d >= 1 << 62:
        a, greatest = a.astype(object), greatest.astype(object)
    width = max(1, int(np.max(a @ greatest)).bit_length())
    fields = DOUBLE_BITS // width
    kind = np.float64 if fields >= 2 else object
    if kind is object:
        fields = WIDE_FIELDS
    full = -(-n // fields) * fields
    if full > n:
        c = np.concatenate([c, np.zeros((full - n, d), c.dtype)])
    words = np.zeros((full // fields, d), kind)
    for f in range(fields):
        words += c[f::fields].astype(kind) * (1 << width * f)
    sums = a.astype(kind) @ words.T  # one multiplication per anchor component and word
    if kind is np.float64:
        sums = sums.astype(np.int64)
    out = np.empty((m, full), sums.dtype)
    for f in range(fields):
        out[:, f::fields] = sums >> width * f & (1 << width) - 1
    # the product of (a + low_a) and (c + low_c), summed over the dimensions
    exact, a_sums, c_sums = out[:, :n], a.sum(axis=1), c[:n].sum(axis=1)
    most = abs(low_a * low_c) * d + abs(low_c) * int(a_sums.max()) + abs(low_a) * int(c_sums.max())
    if kind is object or most >= 1 << 62:
        exact, a_sums, c_sums = (x.astype(object) for x in (exact, a_sums, c_sums))
    return exact + (low_c * a_sums + d * low_a * low_c)[:, None] + (low_a * c_sums)[None, :]


def _as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return scores
    return np.array([min(max(int(s), -_LONG - 1), _LONG) for s in scores.ravel()], np.int64).reshape(scores.shape)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part; ``vec`` holds doubles."""
    vec = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                           vec.alias("vec"))
            .where(F.col("label").isNotNull() & F.col("vec").isNotNull()).where(~bad))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list column."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return lengths, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number rows of a list column, for each length of vector."""
    lengths, values = _lists(column)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, _whole(values[starts[rows][:, None] + np.arange(d)])


def _best(pair: np.ndarray, score: np.ndarray, vec_id: np.ndarray, null: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the first ``most`` entries of each pair: higher scores first, then smaller ids, NULL ids last."""
    order = np.lexsort((vec_id, null, ~score, pair))
    p = pair[order]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    place = np.arange(len(p)) - np.repeat(first, np.diff(np.r_[first, len(p)]))
    return order[place < most]


class _Search:
    """The best few rows per slot of one block of anchors; ``slots`` score ranges an anchor."""

    def __init__(self, block: dict, same_label: bool, most: int):
        self.block, self.same, self.most = block, same_label, most
        self.slots = block["low"].shape[1]
        n = len(block["label"]) * self.slots
        self.floor = block["low"].copy()  # below this score nothing can enter a slot any more
        self.n = n
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def add(self, ids: pa.Array, labels: np.ndarray, vectors: pa.Array) -> None:
        null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
        ids = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        for rows, whole in _by_length(vectors):
            for mine, anchors in self.block["vectors"].get(whole.shape[1], []):
                step = max(1, TILE // max(1, len(mine)))
                for at in range(0, len(rows), step):
                    r = rows[at:at + step]
                    self._tile(mine, _as_long(packed_products(anchors, whole[at:at + step])), ids[r], null[r], labels[r])

    def _tile(self, mine: np.ndarray, scores: np.ndarray, ids: np.ndarray, null: np.ndarray, labels: np.ndarray) -> None:
        fits = (self.block["label"][mine][:, None] == labels[None, :]) == self.same
        fits &= scores >= self.floor[mine].min(axis=1)[:, None]
        fits &= scores <= self.block["high"][mine].max(axis=1)[:, None]
        a, c = np.nonzero(fits)
        s = scores[a, c]
        found = [self.kept]
        for slot in range(self.slots):
            ok = (s >= self.floor[mine[a], slot]) & (s <= self.block["high"][mine[a], slot])
            found.append((mine[a[ok]] * self.slots + slot, s[ok], ids[c[ok]], null[c[ok]]))
        pair, score, vec_id, is_null = (np.concatenate(x) for x in zip(*found))
        best = _best(pair, score, vec_id, is_null, self.most)
        self.kept = pair[best], score[best], vec_id[best], is_null[best]
        full = np.bincount(self.kept[0], minlength=self.n) == self.most
        worst = np.full(self.n, _LONG)
        np.minimum.at(worst, self.kept[0], self.kept[1])
        low = self.floor.reshape(-1)
        low[full] = np.maximum(low[full], worst[full])

    def batch(self) -> pa.RecordBatch:
        pair, score, vec_id, null = self.kept
        return pa.RecordBatch.from_arrays(
            [pa.array(self.block["anchor"][pair // self.slots]), pa.array(pair % self.slots + 1, pa.int32()),
             pa.array(score), pa.array(vec_id, mask=null)], names=["anchor", "slot", "score", "vec_id"])


_FOUND = "anchor long, slot int, score long, vec_id long"


def _search(rows: DataFrame, sent: Broadcast, same_label: bool, most: int) -> DataFrame:
    """The best ``most`` rows of every slot of a block of anchors, over all rows; combined per task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(sent.value, same_label, most)
        for b in batches:
            search.add(b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2))
        yield search.batch()

    found = rows.select("vec_id", "label", "vec").mapInArrow(run, _FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _anchor_blocks(anchors: DataFrame, block_bytes: int) -> Iterator[list]:
    """Rows of ``anchors`` in blocks whose measured bytes are bounded, in order of ``anchor``."""
    bytes_ = 8 * F.size("vec") + 64
    blocks = -(-(anchors.agg(F.sum(bytes_)).first()[0] or 0) // block_bytes)
    while True:  # blocks are dealt by hash; a block above twice the bound is dealt anew
        block = F.pmod(F.xxhash64("anchor"), F.lit(max(1, blocks)))
        dealt = anchors.groupBy(block.alias("b")).agg(F.count("*").alias("n"), F.sum(bytes_).alias("bytes"))
        if (dealt.where("n > 1").agg(F.max("bytes")).first()[0] or 0) <= 2 * block_bytes:
            break
        blocks *= 2
    for b in range(blocks):
        yield sorted(anchors.where(block == b).collect())


def _block(rows: list, ranges: dict | None = None) -> dict:
    """Arrays of a block of anchors, with the score range of each of their slots: all scores, or those of ``ranges``
    ({anchor: [(low, high), ...]}; anchors that it lacks are left out)."""
    if ranges is None:
        ranges = {r["anchor"]: [(-_LONG - 1, _LONG)] for r in rows}
    rows = [r for r in rows if r["anchor"] in ranges]
    slots = max((len(v) for v in ranges.values()), default=1)
    lows, highs = np.full((len(rows), slots), _LONG), np.full((len(rows), slots), -_LONG - 1)
    for i, r in enumerate(rows):
        for k, range_ in enumerate(ranges[r["anchor"]]):
            lows[i, k], highs[i, k] = range_
    vectors = {}
    if rows:
        for mine, whole in _by_length(pa.array([r["vec"] for r in rows], pa.list_(pa.float64()))):
            step = max(1, TILE // 1024)
            vectors[whole.shape[1]] = [(mine[at:at + step], whole[at:at + step]) for at in range(0, len(mine), step)]
    return {"anchor": np.array([r["anchor"] for r in rows], np.int64), "label": np.array([r["label"] for r in rows], np.int64),
            "vectors": vectors, "low": lows, "high": highs}


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column | None = None, positives: int = POSITIVES,
                        negatives: int = NEGATIVES, least: int = LEAST_SHARE, most: int = MOST_SHARE,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per anchor and positive, the first ``negatives`` rows of another label whose score lies in the positive's range.

    ``vectors`` holds vec_id, label and embedding. Returns (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score).
    """
    spark: SparkSession = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors)
    is_anchor = F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor
    anchors = stored(rows.where(is_anchor & F.col("vec_id").isNotNull())
                     .withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    out = None
    for held in _anchor_blocks(anchors, block_bytes):
        sent = spark.sparkContext.broadcast(_block(held))
        near = _search(rows, sent, True, positives + 1).select("anchor", "place", "score", "vec_id").collect()
        sent.unpersist()
        pairs = _positives(held, near, positives)
        ids = {r["anchor"]: r["vec_id"] for r in held}
        positive = spark.createDataFrame(
            [(ids[k], k, i + 1, s, p) for k, v in pairs.items() for i, (s, p) in enumerate(v)],
            "anchor_id long, anchor long, slot int, positive_score long, positive_id long")
        sent = spark.sparkContext.broadcast(
            _block(held, {k: [(-(-least * s // 100), most * s // 100) for s, _ in v] for k, v in pairs.items()}))
        hard = _search(rows, sent, False, negatives).join(F.broadcast(positive), ["anchor", "slot"])
        part = stored(hard.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"),
                                  F.col("vec_id").alias("negative_id"), "positive_score",
                                  F.col("score").alias("negative_score")), "hard_negatives")
        sent.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                     "positive_score long, negative_score long")
    return out


def _positives(held: list, near: list, most: int) -> dict[int, list]:
    """{anchor: [(score, vec_id), ...]} of a block: its best rows but one that is the anchor itself."""
    pairs: dict[int, list] = {}
    for r in sorted(near, key=lambda r: (r["anchor"], r["place"])):
        pairs.setdefault(r["anchor"], []).append((r["score"], r["vec_id"]))
    for r in held:
        whole = _whole(np.array(r["vec"], np.float64)).astype(object)
        itself = (min(int((whole * whole).sum()), _LONG), r["vec_id"])
        found = pairs.get(r["anchor"], [])
        if itself in found:
            found.remove(itself)
        del found[most:]
    return {k: v for k, v in pairs.items() if v}
