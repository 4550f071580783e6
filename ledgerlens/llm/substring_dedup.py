"""Substring dedup by difference-cover anchors.

A document's words are numbered; positions whose number modulo ``PERIOD`` lies in ``COVER`` are anchors. The cover has
two positions of every difference modulo the period, so that of any two equal windows of words, wherever they stand, one
shared offset of the first ``PERIOD`` puts both at an anchor: equal windows of 13 words share an aligned anchor of 7
words. Only 3 of 7 positions are hashed and compared; a window whose anchors are all unshared is alone, and only the
others are extended to 13 words, hashed whole (96 bits) and traced to the least document that holds them.

Documents are dealt to blocks of a few MB, a task's unit. Everything that leaves a block is combined there first: an
anchor or window that thousands of documents of a block share is sent once. It goes to buckets of hashes, whose number
follows the input, as arrays (an anchor takes 4 bytes: the bucket tells the rest); the answers go back to the blocks
that asked. No pair of documents is ever listed, and the blocks of text are shuffled once, for all three steps.

Cases: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a NULL or empty text has none; rows of one ``doc_id`` never cost
each other a word; a NULL ``doc_id`` counts as greater than any other; windows are judged on the input, overlaps
included; an empty table gives no rows; further columns travel along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .words import mix, word_hashes

WINDOW_WORDS = 13
PERIOD = 7
#: A difference cover modulo PERIOD: each residue is a difference of two of these.
COVER = (0, 1, 3)
#: Words of an anchor: what any shared window keeps behind an offset below PERIOD.
ANCHOR_WORDS = WINDOW_WORDS - PERIOD + 1
#: Bytes of text of a block, and of the text whose hashes a bucket compares.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20

_BASE = 0xD1B54A32D192ED03
_INVERSE = pow(_BASE, -1, 1 << 64)
_LAST = (1 << 63) - 1


class _Words:
    """Word hashes of the texts of a block, and hashes of runs of its words."""

    def __init__(self, texts: list[str | None]):
        self.hashes, self.counts = word_hashes(texts, lower=False)
        self.n = len(self.hashes)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        starts = np.cumsum(self.counts) - self.counts
        self.place = np.arange(self.n) - starts[self.doc]
        self.left = self.counts[self.doc] - self.place

    def runs(self, length: int, salt: int = 0) -> np.ndarray:
        """64-bit hash of the run of ``length`` words at every word (of fewer words at the end of the block)."""
        up, down = np.full(self.n + 1, _BASE, np.uint64), np.full(self.n + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        words = mix(self.hashes + np.uint64(salt)) if salt else self.hashes
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)])
        ends = np.minimum(np.arange(self.n) + length, self.n)
        return mix((sums[ends] - sums[:-1]) * down[:-1])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors."""
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= ANCHOR_WORDS))
        return at, self.runs(ANCHOR_WORDS)[at]


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and the 32 bits that tell it from others of its bucket."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), hashes.astype(np.uint32)


def _edges(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal sorted keys."""
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)
    return first, np.r_[first[1:], len(sorted_keys)] if len(first) else first


def _held(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in column]


def _ask_anchors(buckets: int):
    """Distinct anchors of a block, as arrays by bucket."""

    def run(block: pa.Table) -> pa.Table:
        bucket, rest = _dealt(np.unique(_Words(block.column("text").to_pylist()).anchors()[1]), buckets)
        order = np.argsort(bucket, kind="stable")
        first, end = _edges(bucket[order])
        rest = rest[order]
        return pa.table({"bucket": pa.array(bucket[order][first]), "block": pa.array([block.column("block")[0].as_py()] * len(first), pa.int64()),
                         "rest": pa.array([rest[s:e].tobytes() for s, e in zip(first, end)], pa.binary())})

    return run


def _shared_anchors(messages: pa.Table) -> pa.Table:
    """For each message of a bucket, those of its anchors that another block sent as well."""
    parts = [np.unique(x) for x in _held(messages.column("rest"), np.uint32)]
    every = np.sort(np.concatenate(parts))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    found = [x[np.isin(x, shared, assume_unique=True)] for x in parts]
    keep = [i for i, x in enumerate(found) if len(x)]
    return pa.table({"block": messages.column("block").take(pa.array(keep, pa.int64())),
                     "bucket": messages.column("bucket").take(pa.array(keep, pa.int64())),
                     "rest": pa.array([found[i].tobytes() for i in keep], pa.binary())})


def _candidates(words: _Words, answers: pa.Table, buckets: int) -> np.ndarray:
    """Starts of the windows with an anchor that another document holds."""
    at, hashes = words.anchors()
    bucket, rest = _dealt(hashes, buckets)
    key = bucket.astype(np.uint64) << np.uint64(32) | rest.astype(np.uint64)
    told = [np.uint64(b) << np.uint64(32) | x.astype(np.uint64)
            for b, x in zip(answers.column("bucket").to_pylist(), _held(answers.column("rest"), np.uint32))]
    shared = np.isin(key, np.concatenate(told)) if told else np.zeros(len(key), bool)
    order = np.argsort(key, kind="stable")  # within the block: two documents at least
    first, end = _edges(key[order])
    doc = words.doc[at[order]]
    shared[order] |= np.repeat(doc[first] != doc[end - 1], end - first)
    marks = np.zeros(words.n + PERIOD + 1, np.int64)
    marks[at[shared] + 1] = 1
    sums = np.cumsum(marks)
    starts = np.arange(words.n)
    return np.flatnonzero((sums[starts + PERIOD] > sums[starts]) & (words.left >= WINDOW_WORDS))


def _ids(block: pa.Table) -> np.ndarray:
    return np.asarray(block.column("id").to_numpy(), np.int64)


def _ask_windows(buckets: int):
    """Distinct candidate windows of a block with the least id that holds each, as arrays by bucket."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        none = pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "window": pa.array([], pa.binary()),
                         "check": pa.array([], pa.binary()), "least": pa.array([], pa.binary()), "several": pa.array([], pa.binary())})
        if not block.num_rows:
            return none
        words = _Words(block.column("text").to_pylist())
        starts = _candidates(words, answers, buckets)
        if not len(starts):
            return none
        window, check = words.runs(WINDOW_WORDS)[starts], words.runs(WINDOW_WORDS, 1)[starts].astype(np.uint32)
        ids = _ids(block)[words.doc[starts]]
        order = np.lexsort((ids, window))
        window, check, ids = window[order], check[order], ids[order]
        first, end = _edges(window)
        several = ids[first] != ids[end - 1]
        window, check, least = window[first], check[first], ids[first]
        bucket = _dealt(window, buckets)[0]
        order = np.lexsort((least, bucket))  # ids in order take little room once compressed
        first, end = _edges(bucket[order])
        cut = lambda x: pa.array([x[order][s:e].tobytes() for s, e in zip(first, end)], pa.binary())
        return pa.table({"bucket": pa.array(bucket[order][first]), "block": pa.array([block.column("block")[0].as_py()] * len(first), pa.int64()),
                         "window": cut(window), "check": cut(check), "least": cut(least), "several": cut(several)})

    return run


def _least_holders(messages: pa.Table) -> pa.Table:
    """For each message, the windows that some document of its block must lose, with the least id that keeps them."""
    parts = [_held(messages.column(c), kind) for c, kind in
             (("window", np.uint64), ("check", np.uint32), ("least", np.int64), ("several", np.bool_))]
    window, check, least, several = (np.concatenate(p) for p in parts)
    source = np.repeat(np.arange(messages.num_rows), [len(x) for x in parts[0]])
    order = np.lexsort((least, check, window))
    w, c = window[order], check[order]
    first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])])
    keeper = np.empty_like(least)
    keeper[order] = np.repeat(least[order][first], np.diff(np.r_[first, len(w)]))
    lost = np.flatnonzero((keeper < least) | several)
    lost = lost[np.lexsort((keeper[lost], source[lost]))]
    first, end = _edges(source[lost])
    return pa.table({"block": messages.column("block").take(pa.array(source[lost][first])),
                     "window": pa.array([window[lost[s:e]].tobytes() for s, e in zip(first, end)], pa.binary()),
                     "keeper": pa.array([keeper[lost[s:e]].tobytes() for s, e in zip(first, end)], pa.binary())})


def _remove(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Kept text and counts of every document of a block."""
    texts = block.column("text").to_pylist()
    words = _Words(texts)
    gone = np.zeros(words.n + 1, np.int64)
    if answers.num_rows and words.n:
        window = np.concatenate(_held(answers.column("window"), np.uint64))
        keeper = np.concatenate(_held(answers.column("keeper"), np.int64))
        order = np.argsort(window)
        window, keeper = window[order], keeper[order]
        own = words.runs(WINDOW_WORDS)
        near = np.minimum(np.searchsorted(window, own), len(window) - 1)
        lost = (window[near] == own) & (words.left >= WINDOW_WORDS) & (_ids(block)[words.doc] > keeper[near])
        at = np.flatnonzero(lost)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + WINDOW_WORDS, -1)
    covered = np.cumsum(gone)[:-1] > 0
    ends = np.cumsum(words.counts)
    kept, removed = [], []
    for text, end, n in zip(texts, ends.tolist(), words.counts.tolist()):
        own = covered[end - n:end]
        pieces = (text or "").encode().split()
        removed.append(int(own.sum()))
        kept.append(b" ".join([p for p, x in zip(pieces, own.tolist()) if not x] if removed[-1] else pieces).decode())
    return pa.table({"rest": block.column("rest"), "n_words": pa.array(words.counts), "n_removed": pa.array(removed, pa.int64()),
                     "kept": pa.array(kept, pa.string())})


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with the words of every repeated window taken out of ``text`` (kept words joined by one space), and
    ``n_words`` and ``n_removed`` per row; other columns as they were (columns of those two names are replaced)."""
    ship_package(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + F.lit(16))).first()[0] or 1
    blocks, buckets = -(-size // block_bytes), -(-size // bucket_bytes)
    # rows of one id and text are spread by the input's partitions, so that no block gathers them all
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.spark_partition_id()), F.lit(blocks))
    dealt = docs.select(place.alias("block"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"))
    result = (T.StructType([T.StructField("rest", dealt.schema["rest"].dataType)]).add("n_words", "long")
              .add("n_removed", "long").add("kept", "string"))
    dealt = dealt.repartition("block")
    by_block = dealt.groupBy("block")
    shared = (by_block.applyInArrow(_ask_anchors(buckets), "bucket long, block long, rest binary")
              .groupBy("bucket").applyInArrow(_shared_anchors, "block long, bucket long, rest binary"))
    holders = (by_block.cogroup(shared.groupBy("block"))
               .applyInArrow(_ask_windows(buckets), "bucket long, block long, window binary, check binary, least binary, several binary")
               .groupBy("bucket").applyInArrow(_least_holders, "block long, window binary, keeper binary"))
    out = by_block.cogroup(holders.groupBy("block")).applyInArrow(_remove, result)
    columns = [F.col("kept").alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns
               if c not in ("n_words", "n_removed")]
    return out.select(*columns, "n_words", "n_removed")
