"""Document fingerprints from closed syncmers.

Of all runs of ``k`` characters, those are anchors whose least inner run of ``s`` characters (by hash) lies at their
first or last place. That choice looks at the run alone, so the same passage has the same anchors wherever it stands.
A fingerprint lists all distinct anchors with their first positions, as hashes and gaps, at every length of text.

The likeness of two fingerprints is the share of anchors in the longest chain of anchors that stand in the same order
in both: twice the chain over the sum of the anchors.

Texts of fewer than ``SHORT_CHARS`` characters are written with anchors of their own, shorter size. A pair is compared at
one size: the shorter one if either text is short, for which the longer text's anchors are taken again from its text.
A pair with a text too short for any anchor of that size is compared by its distinct characters.

Cases: a NULL text is an empty one; empty texts are alike (1.0) and unlike any other (0.0); a text without any anchor is
written with itself as its only one; repeated rows and ties of ``doc_id`` follow in the order of their text hash; a NULL id
stands before all others; the next document of the last one is the first, and of an only one itself; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

K = 16
S = 6
#: Anchors of short texts.
SHORT_CHARS = 96
SHORT_K = 5
SHORT_S = 2
#: Anchors of a pair with a text that has none of the above: single characters.
LEAST_K = LEAST_S = 1
#: A batch of rows is given out at so many bytes of fingerprints.
OUT_BYTES = 8 << 20
#: Characters hashed at once; windows run across the cuts.
BLOCK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _run_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = h * _BASE + codes[i:len(codes) - n + 1 + i]
    return mix(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit anchor hashes of a whole text, by first position, and these positions."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < k:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes, places = [], []
    for at in range(0, len(codes) - k + 1, BLOCK):
        part = codes[at:at + BLOCK + k - 1].astype(np.uint64)
        inner = _run_hashes(part, s)
        least = _least(inner, k - s + 1)
        edge = np.flatnonzero((inner[:len(least)] == least) | (inner[k - s:] == least))
        hashes.append((_run_hashes(part, k)[edge] >> np.uint64(32)).astype(np.uint32))
        places.append(edge + at)
    found, place = np.concatenate(hashes), np.concatenate(places)
    _, first = np.unique(found, return_index=True)
    first.sort()
    return found[first], place[first]


class Fingerprint:
    """All anchors of a text, of ``k`` characters each; ``whole`` tells that there are none, and the text stands for them.

    It keeps its text, for pairs that are compared at another size; one that was read back has none, unless given to
    ``parse``, and is then unlike texts of the other size.
    """

    __slots__ = ("k", "s", "text", "whole", "hashes", "places")

    def __init__(self, text: str | None, k: int = K, s: int = S):
        text = text or ""
        if len(text) < SHORT_CHARS and k > SHORT_K:
            k, s = SHORT_K, SHORT_S
        self.k, self.s, self.text = k, s, text
        self.hashes, self.places = anchors(text, k, s)
        self.whole = bool(text) and not len(self.hashes)

    def __str__(self) -> str:
        """``k:width:`` and base64 of hashes (4 bytes each) and gaps (``width`` bytes each); of width 0, the text itself."""
        if self.whole:
            return f"{self.k}:0:{base64.b64encode(self.text.encode('utf-8', 'surrogatepass')).decode()}"
        gaps = np.diff(self.places, prepend=0)
        most = int(gaps.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        data = self.hashes.astype("<u4").tobytes() + gaps.astype(f"<u{width}").tobytes()
        return f"{self.k}:{width}:{base64.b64encode(data).decode()}"

    @classmethod
    def parse(cls, written: str, text: str | None = None) -> Fingerprint:
        k, width, data = written.split(":")
        values = base64.b64decode(data)
        out = cls.__new__(cls)
        out.k, out.text, out.whole = int(k), text, width == "0"
        out.s = SHORT_S if out.k == SHORT_K else S
        if out.whole:
            out.text, values, width = values.decode("utf-8", "surrogatepass"), b"", 1
        n = len(values) // (4 + int(width))
        out.hashes = np.frombuffer(values, "<u4", n)
        out.places = np.cumsum(np.frombuffer(values, f"<u{width}", n, 4 * n), dtype=np.int64)
        return out

    def _hashes(self, k: int, s: int) -> np.ndarray | None:
        """Anchors of another size; None without the text."""
        if k == self.k:
            return self.hashes
        return None if self.text is None else anchors(self.text, k, s)[0]

    def likeness(self, other: Fingerprint) -> float:
        """Share of anchors in the longest chain of the same order, 0 to 1."""
        empty, other_empty = (not len(f.hashes) and not f.whole for f in (self, other))
        if empty or other_empty:
            return float(empty and other_empty)
        k, s = min((self.k, self.s), (other.k, other.s))
        a, b = self._hashes(k, s), other._hashes(k, s)
        if a is not None and b is not None and not (len(a) and len(b)):
            a, b = self._hashes(LEAST_K, LEAST_S), other._hashes(LEAST_K, LEAST_S)
        if a is None or b is None:
            return 0.0
        _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        ends: list[int] = []
        last = -1
        for i in to[np.argsort(at)].tolist():
            if i > last:
                ends.append(i)
            else:
                ends[bisect_left(ends, i)] = i
            last = ends[-1]
        return 2 * len(ends) / (len(a) + len(b))


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                  ("near_next", pa.float64())])
_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


#: Ranges of ids; bounds the quantile sketches, the constant array of cuts and the table of first documents.
MAX_RANGES = 1 << 14


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """At most ``n`` - 1 ids that cut ``docs`` in ranges of about equal size."""
    cuts = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return sorted({int(c) for c in cuts})


def fingerprint_with_next(docs: DataFrame, ranges: int | None = None, k: int = K, s: int = S) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and the likeness to this and to the next document's.

    The ids are cut in ``ranges`` of about equal size (four to a shuffle partition, ``MAX_RANGES`` at most), and each
    range also receives the first document after it: one text more per range, and no other text is copied. A task
    streams its ranges in order and holds two documents at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(
        F.col("text").cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        ranges = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    cuts = _ranges(rows.select("doc_id"), ranges)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(
        F.expr(f"cast({_count_below('doc_id', cuts)} AS int)")))
    order = F.struct(F.col("doc_id").isNotNull().alias("ided"), "doc_id", F.xxhash64("text").alias("text_hash"))
    # the first document of each range by a figure of fixed size; the driver gets one row per range
    heads = rows.groupBy("range").agg(F.min(order).alias("head")).orderBy("range").collect()
    if not heads:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), _DDL)
    before = {h["range"]: heads[i - 1]["range"] for i, h in enumerate(heads)}  # the first one follows the last
    first = spark.createDataFrame(
        [(h["range"], h["head"]["doc_id"], h["head"]["text_hash"], before[h["range"]]) for h in heads],
        "range int, head_id long, head_hash long, goes_to int")
    copies = (rows.join(F.broadcast(first), "range")
              .where(F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.xxhash64("text") == F.col("head_hash")))
              .select(F.col("goes_to").alias("range"), "doc_id", "text", F.lit(True).alias("after")))
    dealt = (rows.select("range", "doc_id", "text", F.lit(False).alias("after")).unionByName(copies)
             .repartition("range").withColumn("text_hash", F.xxhash64("text"))
             .sortWithinPartitions("range", "after", "doc_id", "text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, doc_id, text, fingerprint) that waits for its next document
        out, held = [], 0
        for b in batches:
            for rng, doc_id, text, after in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2),
                                                b.column(3).to_pylist(), strict=True):
                if after and (last is None or last[0] != rng):
                    continue  # a repeated head: the range is done
                text = text.as_py()
                fp = Fingerprint(text, k, s)
                if last is not None and last[0] == rng:
                    out.append(_row(*last[1:], text, fp))
                    held += len(out[-1][3]) + len(out[-1][4])
                    if held >= OUT_BYTES:
                        yield batch(out)
                        out, held = [], 0
                last = None if after else (rng, doc_id, text, fp)
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    def _row(doc_id, text, fp, following, next_fp):
        changed = edited(text, following)
        changed_fp = Fingerprint(changed, k, s)
        return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), str(fp), str(changed_fp),
                fp.likeness(changed_fp), fp.likeness(next_fp))

    return dealt.select("range", "doc_id", "text", "after").mapInArrow(run, _DDL)


def _count_below(column: str, cuts: list[int]) -> str:
    """SQL for the number of the ascending ``cuts`` below the column, by halving steps over one constant array."""
    if not cuts:
        return "0"
    steps = ", ".join(str(1 << k) for k in reversed(range(len(cuts).bit_length())))
    held = f"array({', '.join(f'{c}L' for c in cuts)})"
    return (f"aggregate(array({steps}), 0, (low, step) -> CASE WHEN low + step <= {len(cuts)} "
            f"AND element_at({held}, least(low + step, {len(cuts)})) < {column} THEN low + step ELSE low END)")
