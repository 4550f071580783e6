"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

A fingerprint has 64 bits in 4 segments. If two differ in at most ``t`` bits, then for some segment ``i`` every chain of
consecutive segments from ``i`` (around the ring) has cumulative differences within its share: 1 segment t/4, 2
segments 2t/4, and so on. Two fingerprints are therefore compared in bucket ``i`` only, keyed by what the first
links of such a chain leave equal, and a pair counts there only if its whole chain from ``i`` stays within budget;
the last link of the chain is the full Hamming check.

Only distinct fingerprints are compared: copies share one. A bucket reports a spanning forest of its links, never its
pairs, so that a group of thousands of near copies costs its size in rows. Buckets above ``bucket_rows`` are cut into
blocks that are compared two at a time in separate tasks.

Cases: a NULL text and one without words have fingerprint zero and are linked like any other; repeated rows and ties
share a fingerprint; a component is named by its least ``doc_id`` (NULL ids are left out of that choice; a component of
NULL ids only has a NULL name); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import stored, words_of
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = 4
SEGMENT_BITS = 64 // SEGMENTS
#: A bucket of more fingerprints is cut into blocks of about this size.
BUCKET_ROWS = 20_000
#: Most fingerprints compared at once.
TILE = 4096


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text: bit j is set if it is set in over half of the shingle hashes."""
    from xxhash import xxh64_intdigest as h

    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return h(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words))).tolist()
    hashes = np.array([h(joined[s:e], seed) for s, e in zip(starts, ends[shingle_words - 1:].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k:k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id long, text_hash long, fp long) per row of ``docs``; ``fp`` holds the 64 bits as a signed number."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words, seed) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
            .mapInArrow(run, "doc_id long, text_hash long, fp long"))


def chain_within(a: np.ndarray, b: np.ndarray, first: int, max_bits: int) -> np.ndarray:
    """Whether every chain of consecutive segments from ``first`` keeps its proportional budget.

    The chain of all segments is the Hamming distance, so True is a proven link.
    """
    diff = a ^ b
    mask = np.uint64((1 << SEGMENT_BITS) - 1)
    total, ok = np.zeros(diff.shape, np.int16), np.ones(diff.shape, bool)
    for length in range(1, SEGMENTS + 1):
        at = np.uint64((first + length - 1) % SEGMENTS * SEGMENT_BITS)
        total += np.bitwise_count((diff >> at) & mask)
        ok &= total * SEGMENTS <= length * max_bits
    return ok


def _forest(fps: np.ndarray, first: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the components of one bucket: a search that compares each reached fingerprint with those not
    reached yet only, so that a dense group is done after a few comparisons of all."""
    links, left = [], fps
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            tile = frontier[:max(1, TILE * TILE // len(left) // 16)]
            hit = chain_within(tile[:, None], left[None, :], first, max_bits)
            got = hit.any(axis=0)
            links += zip(tile[hit.argmax(axis=0)[got]].tolist(), left[got].tolist(), strict=True)
            frontier, left = np.concatenate([frontier[len(tile):], left[got]]), left[~got]
    return links


def _bucket_keys(fp: str) -> str:
    """SQL array of (segment, key): a chain's first segment is equal, and one half of the next one at least.

    Budgets of t <= 3 bits give a first segment no difference and the first two together at most one, so one half of
    the second segment is equal as well.
    """
    half, seg = SEGMENT_BITS // 2, (1 << SEGMENT_BITS) - 1
    keys = []
    for i in range(SEGMENTS):
        nxt = (i + 1) % SEGMENTS * SEGMENT_BITS
        for j in range(2):
            keys.append(f"struct({i} AS seg, (shiftrightunsigned({fp}, {i * SEGMENT_BITS}) & {seg}L) * {1 << half}L"
                        f" + (shiftrightunsigned({fp}, {nxt + j * half}) & {(1 << half) - 1}L)"
                        f" + {(i * 2 + j) << 40}L AS key)")
    return "array(" + ", ".join(keys) + ")"


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect all pairs within ``max_bits`` bits.

    The table must hold each fingerprint once. Keys are exact for ``max_bits`` up to 3.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the bucket keys are exact for 0 to 3 bits")
    rows = fps.select("fp", F.explode(F.expr(_bucket_keys("fp"))).alias("k")).select("fp", "k.seg", "k.key")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / bucket_rows).cast("int"))
    # block r of a large bucket meets every block t, at (least, greatest) of the two
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(fp), blocks) AS int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("fp", "seg", "key", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("t"))
    keyed = rows.repartition("key", "r", "t").sortWithinPartitions("key", "r", "t", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def close() -> pa.RecordBatch:
            fp = np.concatenate([h for h in held]).view(np.uint64)
            found = _forest(fp, last[0], max_bits) if len(fp) > 1 else []
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for b in batches:
            fp, seg, key, r, t = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(fp):
                continue
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(r) != 0) | (np.diff(t) != 0)) + 1
            edges = [0, *new.tolist(), len(fp)]
            done: list[pa.RecordBatch] = []
            for s, e in zip(edges, edges[1:]):
                now = (int(seg[s]), int(key[s]), int(r[s]), int(t[s]))
                if now != last and held:
                    done.append(close())
                    held = []
                held.append(fp[s:e])
                last = now
            yield from done
        if held:
            yield close()

    return keyed.mapInArrow(run, "u long, v long")


def _rooted(docs: DataFrame, shingle_words: int, max_bits: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``fingerprints`` of all rows, and (fp, least, root) of every distinct fingerprint."""
    marked = stored(fingerprints(docs, shingle_words, seed), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links(classes.select("fp"), max_bits))
    return marked, (classes.join(roots, classes.fp == roots.node, "left")
                    .select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``."""
    marked, named = _rooted(docs, shingle_words, max_bits, seed)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # as a table of its own, so that Spark may split the partitions of a fingerprint that very many copies share
    named = stored(named.select("fp", "root").join(names, "root").select("fp", "component_id"), "components")
    return marked.select("doc_id", "fp").join(named, "fp")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
             seed: int = SEED) -> DataFrame:
    """One row of ``docs`` for each component; columns as before.

    It is the row of the least ``doc_id`` (NULL ids last), among rows of one id that of the least text hash, and of
    rows that repeat id and text any one.
    """
    marked, named = _rooted(docs, shingle_words, max_bits, seed)
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    # first per fingerprint, so that the copies of one text do not meet at their component
    first = stored(marked.groupBy("fp").agg(F.min(order).alias("k")), "first")
    kept = (first.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("k").alias("k"))
            .select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return (rows.join(kept, same, "left_semi").groupBy("doc_id", "text_hash")
            .agg(F.min_by("row", F.xxhash64(*(F.col("row")[c] for c, t in docs.dtypes if not t.startswith("map")))).alias("row"))
            .select(*(F.col("row")[c].alias(c) for c in docs.columns)))
