"""Benchmark decontamination by item-sized windows.

Both sides are shingles of five words. For every item size, each window of a document with as many words as the item
gets a 64-bit SimHash; a multi-index over five blocks (items are entered under all values within 3 bits of a block of
13, or 2 bits of one of 12) finds every item of that size within ``4 * 4 + 3 - 1 = 18`` bits, and the exact similarity
of the two weighted shingle sets (repeats count) decides.

Windows that hold too few shingles of any item to reach the similarity are never formed. That test uses a bitmap of
fixed size over the items' shingles: it has no false negatives, so a large benchmark makes it weaker but never wrong.
A window is written as its place, its fingerprint and a hash of its shingles. Equal windows are verified once, in the
document of the least key: the texts of these documents, the items found near and the windows are sorted together, and
a task streams them, holding one text and one item at a time.

Cases: a NULL text has no words; an item of fewer than five words has no shingle and matches nothing; a document
shorter than an item is one window; repeated documents give their own rows, repeated item ids the row of their best
window, items without an id likewise; a document is its (doc_id, text); empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_key, stored
from .words import mix, shingle_hashes, word_hashes

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
#: Bits of each block of a fingerprint, and the bits in which an item may differ there.
BLOCKS = ((13, 3), (13, 3), (13, 3), (13, 3), (12, 2))
RADIUS = sum(r + 1 for _, r in BLOCKS) - 1
ENTRIES = sum(math.comb(bits, k) for bits, r in BLOCKS for k in range(r + 1))
#: The index of the items is broadcast up to so many bytes, at so many an entry; beyond that it is shuffled.
MAX_INDEX_BYTES, ENTRY_BYTES = 64 << 20, 160
#: Size of the bitmap of item shingles that every task holds: 2**24 bits are 2 MB.
BITMAP_BITS = 24
#: Buckets of document keys; at most so many numbers are broadcast to leave out the texts that no window is near in.
DOC_BUCKETS = 1 << 20
#: Windows in a batch that a task writes.
BATCH_WINDOWS = 1 << 16


def _simhash(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints from per-bit counts (rows, 64) of ``n`` hashes each."""
    return np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _items(benchmark: DataFrame, shingle_words: int) -> DataFrame:
    """(item_id, size, fp, shingles) of every item that has a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = word_hashes([text])[0]
                s = shingle_hashes(words, shingle_words)
                if len(s):
                    fp = _simhash(_bits(s).sum(axis=0, dtype=np.int64)[None, :], np.array([len(s)]))
                    rows.append((item, len(words), int(fp.view(np.int64)[0]), s.view(np.int64).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "size", "fp", "shingles"), r)) for r in rows], _ITEM)

    found = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .mapInArrow(run, "item_id long, size int, fp long, shingles array<long>"))
    return found.withColumn("item", F.xxhash64("item_id", "size", "shingles")).dropDuplicates(["item"])


_ITEM = pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("fp", pa.int64()),
                   ("shingles", pa.list_(pa.int64()))])
_WINDOW = "_doc long, _text_hash long, doc_id long, size int, start_word long, fp long, print long"


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bitmap of the items' shingles, combined in Spark; its size does not depend on the benchmark."""
    place = F.shiftrightunsigned("shingle", 64 - BITMAP_BITS)
    words = (items.select(F.explode("shingles").alias("shingle")).select(place.alias("at")).groupBy(F.expr("cast(at div 64 AS int)").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits")).toPandas())
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _least_shared(own: int, other: int, similarity: float) -> int:
    """Shingles that two sets of these sizes share at least if they are so similar."""
    return int(np.ceil((own + other) * similarity / (1 + similarity) - 1e-9))


class _Prints:
    """Hashes of any runs of a text's shingles, from one pass over it.

    A run's hash is a polynomial of its shingles modulo 2^64, mixed with its length: with the powers of the inverse of
    the (odd) base summed up once, a run is the difference of two sums, shifted to the run's first shingle."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def start(self, shingles: np.ndarray) -> None:
        n = len(shingles) + 1
        if len(self.up) < n:
            powers = np.full((2, n), [[self.BASE], [pow(self.BASE, -1, 1 << 64)]], np.uint64)
            powers[:, 0] = 1
            self.up, self.down = np.multiply.accumulate(powers, axis=1)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(shingles * self.down[:n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, n: int) -> np.ndarray:
        return mix((self.sums[starts + n] - self.sums[starts]) * self.up[starts] ^ np.uint64(n))


def _windows(docs: DataFrame, sizes: list[int], bitmap, shingle_words: int, min_similarity: float) -> DataFrame:
    """Windows of the item sizes that hold enough shingles of any item, with their fingerprint and hash."""

    def of_text(words: np.ndarray, prints: _Prints) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, starts, fingerprints, hashes)."""
        s = shingle_hashes(words, shingle_words)
        at = s >> np.uint64(64 - BITMAP_BITS)
        hit = (bitmap.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        if not hit.any():
            return
        upto = np.concatenate([[0], np.cumsum(hit)])
        started = False
        for size in sizes:
            full = size - shingle_words + 1
            n = min(full, len(s))
            starts = np.flatnonzero(upto[n:] - upto[:-n] >= max(1, _least_shared(n, full, min_similarity)))
            if not len(starts):
                continue
            if not started:
                prints.start(s)
                started = True
            for k in range(0, len(starts), 4096):
                some = starts[k:k + 4096]
                # a stretch of windows far apart is cut, so that the sums span windows that overlap only
                for run in np.split(some, np.flatnonzero(np.diff(some) > n) + 1):
                    low, high = int(run[0]), int(run[-1]) + n
                    sums = np.zeros((high - low + 1, 64), np.int32)
                    np.cumsum(_bits(s[low:high]), axis=0, out=sums[1:])
                    fp = _simhash(sums[run - low + n] - sums[run - low], np.full(len(run), n))
                    yield size, run, fp, prints.of(run, n)

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        part = pa.array(np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts]))
        key = [pa.array([p[0][i] for p in parts], pa.int64()).take(part) for i in range(3)]
        starts, fps, prints = (pa.array(np.concatenate([p[i] for p in parts]).view(np.int64)) for i in (2, 3, 4))
        return pa.RecordBatch.from_arrays([*key, pa.array([p[1] for p in parts], pa.int32()).take(part), starts, fps, prints],
                                          names=[c.split()[0] for c in _WINDOW.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = _Prints()
        for b in batches:
            keys = [b.column(i).to_pylist() for i in range(3)]
            words, counts = word_hashes(b.column(3).to_pylist())
            parts, held, at = [], 0, 0
            for *key, n in zip(*keys, counts.tolist(), strict=True):
                for part in of_text(words[at:at + n], prints):
                    parts.append((key, *part))
                    held += len(part[1])
                    if held >= BATCH_WINDOWS:
                        yield batch(parts)
                        parts, held = [], 0
                at += n
            if parts:
                yield batch(parts)

    return (docs.select(*document_key(), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text")).mapInArrow(run, _WINDOW))


def _blocks(value: str, near: bool) -> str:
    """SQL array of (block, value) of a fingerprint, entered under all near values if asked."""
    out, at = [], 0
    for k, (bits, radius) in enumerate(BLOCKS):
        own = f"{k << 16} + cast(shiftrightunsigned({value}, {at}) & {(1 << bits) - 1}L AS int)"
        masks = [m for m in range(1 << bits) if m.bit_count() <= radius]
        out.append(f"transform(array({', '.join(map(str, masks))}), m -> ({own}) ^ m)" if near else f"array({own})")
        at += bits
    return f"concat({', '.join(out)})"


def _verify(docs: DataFrame, items: DataFrame, near: DataFrame, shingle_words: int, min_similarity: float) -> DataFrame:
    """(size, fp, print, item_id, bits, similarity) of the ``near`` windows that are as similar to their item."""
    key = ["_doc", "_text_hash"]
    columns = ("item long, kind int, text string, shingles array<long>, item_id long, size int, start_word long, fp long, "
               "print long, bits int").split(", ")

    def rows(df: DataFrame, kind: int) -> DataFrame:
        given = {"kind": F.lit(kind)} | {c: F.col(c) for c in df.columns}
        return df.select(*key, *(given.get(name, F.lit(None)).cast(kind_of).alias(name)
                                 for name, kind_of in (c.split() for c in columns)))

    # texts are shuffled only if their bucket holds a wanted document: no wanted one is left out
    bucket = F.pmod(F.xxhash64(*key), F.lit(DOC_BUCKETS)).alias("bucket")
    texts = (docs.select(*document_key(), "text").select("*", bucket)
             .join(F.broadcast(near.select(bucket).distinct()), "bucket", "left_semi")
             .join(near.select(*key).distinct(), key, "left_semi"))
    asked = near.select(*key, "item").distinct().join(items.select("item", "shingles"), "item")
    # of a document the text comes first, of an item its shingles, then its windows
    dealt = (rows(texts, 0).unionByName(rows(asked, 1)).unionByName(rows(near, 2)).repartition(*key)
             .sortWithinPartitions(*key, F.col("item").asc_nulls_first(), "kind"))
    names = ["size", "fp", "print", "item_id", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = values = counts = None
        for b in batches:
            kinds, texts, wanted = b.column("kind").to_pylist(), b.column("text"), b.column("shingles")
            sizes, starts = b.column("size").to_pylist(), b.column("start_word").to_pylist()
            kept, similar = [], []
            for i, kind in enumerate(kinds):
                if kind == 0:
                    shingles = shingle_hashes(word_hashes([texts[i].as_py()])[0], shingle_words)
                elif kind == 1:
                    own = wanted[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    values, counts = np.unique(own, return_counts=True)
                else:
                    window = shingles[starts[i]:starts[i] + sizes[i] - shingle_words + 1]
                    at = np.minimum(np.searchsorted(values, window), len(values) - 1)
                    at = at[values[at] == window]
                    shared = int(np.minimum(np.bincount(at, minlength=len(values)), counts).sum())
                    similarity = shared / (len(window) + int(counts.sum()) - shared)
                    if similarity >= min_similarity:
                        kept.append(i)
                        similar.append(similarity)
            if kept:
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(kept)) for c in names),
                                                  pa.array(similar, pa.float64())], names=[*names, "similarity"])

    return dealt.mapInArrow(run, "size int, fp long, print long, item_id long, bits int, similarity double")


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS,
                         min_similarity: float = MIN_SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(_doc, _text_hash, doc_id, item_id, start_word, n_words, similarity, bits): the most similar window of each
    document and item, the first of equals."""
    if radius > RADIUS:
        raise ValueError(f"the block index holds all fingerprints within {RADIUS} bits")
    items = stored(_items(benchmark, shingle_words), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(items))
    windows = stored(_windows(docs, sizes, sent, shingle_words, min_similarity), "windows")
    shape = ["size", "fp", "print"]
    shapes = windows.groupBy(*shape).agg(F.min(F.struct("_doc", "_text_hash", "start_word")).alias("at"))
    index = items.select("item", "item_id", "size", F.col("fp").alias("item_fp"),
                         F.explode(F.expr(_blocks("fp", True))).alias("block"))
    small = items.count() * ENTRIES * ENTRY_BYTES <= MAX_INDEX_BYTES
    near = (shapes.select(*shape, "at.*", F.explode(F.expr(_blocks("fp", False))).alias("block"))
            .join(F.broadcast(index) if small else index.hint("merge"), ["size", "block"])
            .withColumn("bits", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
            .where(F.col("bits") <= radius)
            .select(*shape, "_doc", "_text_hash", "start_word", "item", "item_id", "bits").distinct())
    # as a table of its own, so that Spark may split the partitions of a passage that very many documents hold
    proven = stored(_verify(docs, items, stored(near, "near"), shingle_words, min_similarity), "proven")
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("later"), "size", "bits"))
    return (windows.join(proven, shape)
            .groupBy("_doc", "_text_hash", "doc_id", "item_id").agg(best.alias("b"))
            .select("_doc", "_text_hash", "doc_id", "item_id", (-F.col("b.later")).alias("start_word"),
                    F.col("b.size").cast("long").alias("n_words"), "b.similarity", F.col("b.bits").cast("long").alias("bits")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS,
                  min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item; columns as before."""
    bad = contaminated_windows(docs, benchmark, shingle_words, min_similarity).select("_doc", "_text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), *document_key()).join(bad, ["_doc", "_text_hash"], "left_anti")
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
