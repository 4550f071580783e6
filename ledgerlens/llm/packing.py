"""Bounded-space online packing of token sequences.

Each task streams its documents and keeps at most ``open_windows`` windows open. A document's full windows leave
at once; its rest is placed best-fit. When none fits and no further window may be opened, the piece's head fills the
gap of the fullest window, which is emitted, and its tail is placed again. What is left open at the end of a task
(bounded, with its ids) is merged per ``merge_fan_in`` tasks in the same way, then poured together, so that one window
per merge group is padded.

Cases: a NULL or empty text is the single id 0; repeated rows are packed each for itself; a NULL ``doc_id`` is kept as
NULL; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 1024
OPEN_WINDOWS = 32
MERGE_FAN_IN = 32
END_ID = 0

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_STAGED = PIECES + ", part int, ids binary"

# Fixed value: how byte-level vocabularies of this kind cut a text into words.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters in a row, with or without white space, from which a text goes to the slower encoder.
LONG_RUN = 200
_SPACES = re.compile(rf"\s{{{LONG_RUN}}}")


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


def _ranks(spec: dict) -> dict[bytes, int]:
    """Bytes and id of every entry of a byte-level vocabulary whose ids follow the order of its merges."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    odd = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(made):
        raise ValueError("the vocabulary's ids do not follow its merges")
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


def _has_long_run(text: str) -> bool:
    """Whether the text has LONG_RUN characters or more without white space, or of white space, in a row."""
    words = text.split()
    if max(map(len, words), default=0) >= LONG_RUN:
        return True
    gaps = len(text) - sum(map(len, words))
    return gaps - len(words) >= LONG_RUN - 2 and _SPACES.search(text) is not None


@functools.lru_cache(2)
def token_encoder(tokenizer_path: str | None = None) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian 32-bit numbers, without the end id.

    ``tokenizer_path`` names a ``tokenizers`` JSON file of a byte-level vocabulary; by default the public one of 50k
    ids. Texts are encoded by ``tiktoken`` with the ranks of that file, in less than half the time and with the same
    ids; those with very long runs, where its time grows with the square of the run, by ``tokenizers`` itself.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    with open(tokenizer_path, encoding="utf-8") as f:
        quick = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=_ranks(json.load(f)), special_tokens={})

    def encode(text: str) -> bytes:
        if _has_long_run(text):
            return _packed(tokenizer.encode(text, add_special_tokens=False).ids)
        return _packed(quick.encode_ordinary(text))

    return encode


class _Packer:
    """Open windows, each a list of (doc_id, start, ids, doc_tokens); emits through ``out``."""

    def __init__(self, window: int, open_windows: int, out: Callable[[list], None]):
        self.window, self.most, self.out = window, open_windows, out
        self.free: list[tuple[int, int]] = []  # (free places, window number), ascending
        self.pieces: dict[int, list] = {}
        self.made = 0

    def _put(self, at: int, free: int, piece: tuple) -> None:
        held = self.pieces[at]
        held.append(piece)
        free -= len(piece[2]) // 4
        if free:
            bisect.insort(self.free, (free, at))
        else:
            self.out(self.pieces.pop(at))

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        size = self.window * 4
        while len(ids) >= size:
            self.out([(doc_id, start, ids[:size], doc_tokens)])
            ids, start = ids[size:], start + self.window
        while ids:
            n = len(ids) // 4
            k = bisect.bisect_left(self.free, (n, -1))
            if k < len(self.free):  # best fit: the least free places that hold it
                free, at = self.free.pop(k)
                self._put(at, free, (doc_id, start, ids, doc_tokens))
                return
            if len(self.pieces) < self.most:
                self.made += 1
                self.pieces[self.made] = []
                self._put(self.made, self.window, (doc_id, start, ids, doc_tokens))
                return
            free, at = self.free.pop(0)  # none fits: fill the fullest, which leaves
            self._put(at, free, (doc_id, start, ids[: free * 4], doc_tokens))
            ids, start = ids[free * 4:], start + free

    def leftovers(self) -> list[list]:
        return [self.pieces[at] for _, at in self.free]

    def pour(self) -> None:
        """Empty the emptiest windows into the fullest until at most one is not full."""
        while len(self.free) > 1:
            _, at = self.free.pop()
            self.most = len(self.pieces) - 1
            for piece in self.pieces.pop(at):
                self.add(*piece)
        for _, at in self.free:
            self.out(self.pieces.pop(at))
        self.free = []


class _Rows:
    """Rows of emitted windows, numbered from ``base``."""

    def __init__(self, base: int, part: int):
        self.base, self.part, self.n, self.rows = base, part, 0, []

    def window(self, pieces: list) -> None:
        offset, seq = 0, self.base + self.n
        self.n += 1
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, seq, offset, self.part, None))
            offset += n

    def left(self, windows: list[list]) -> None:
        for pieces in windows:
            for doc_id, start, ids, doc_tokens in pieces:
                self.rows.append((doc_id, start, len(ids) // 4, 0, doc_tokens, None, None, self.part, ids))

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows
            else [pa.array([], f.type) for f in schema], schema=schema)


def _arrow(staged: bool) -> pa.Schema:
    longs = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    return pa.schema(longs + ([("part", pa.int32()), ("ids", pa.binary())] if staged else []))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW,
                   open_windows: int = OPEN_WINDOWS, merge_fan_in: int = MERGE_FAN_IN) -> DataFrame:
    """One row per piece of each document of ``docs`` (doc_id, text), with its sequence and its offset there.

    A task holds ``open_windows`` windows, a merge group ``merge_fan_in`` times as many; neither grows with the input.
    Pieces of full windows carry their checksum only, and just the leftovers carry ids through the one shuffle.
    """

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, schema = token_encoder(tokenizer_path), _arrow(True)
        part = TaskContext.get().partitionId()
        rows = _Rows(part << 33, part)
        packer = _Packer(window, open_windows, rows.window)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + END_ID.to_bytes(4, "little")
                packer.add(doc_id, 0, ids, len(ids) // 4)
            if len(rows.rows) > 10_000:
                yield rows.take(schema)
        rows.left(packer.leftovers())
        yield rows.take(schema)

    def merge(key: tuple, held: pa.Table) -> pa.Table:
        schema, group = _arrow(False), key[0].as_py()
        rows = _Rows((1 << 62) | (group << 33), 0)
        packer = _Packer(window, open_windows, rows.window)
        pieces = sorted(zip(*(held.column(n).to_pylist() for n in ("length", "doc_id", "start", "ids", "doc_tokens")),
                            strict=True), key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2], p[3]))
        for _, doc_id, start, ids, doc_tokens in pieces:
            packer.add(doc_id, start, ids, doc_tokens)
        packer.pour()
        return pa.Table.from_batches([rows.take(_arrow(True))]).select(schema.names)

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = stored(one.mapInArrow(online, _STAGED), "packed")
    done = staged.where("ids IS NULL").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                              "offset")
    left = (staged.where("ids IS NOT NULL").withColumn("merge_group", F.expr(f"part div {merge_fan_in}"))
            .select("merge_group", "doc_id", "start", "length", "doc_tokens", "ids"))
    return done.unionByName(left.groupBy("merge_group").applyInArrow(merge, PIECES))
