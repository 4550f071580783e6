"""Language-model scoring with an Elias-Fano n-gram trie.

The model interpolates trigrams, bigrams and unigrams, each level a Dirichlet prior of the next:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w|v)   = (c(v w) + M p(w)) / (c(v) + M)
    p(w|u v) = (c(u v w) + M p(w|v)) / (c(u v) + M)

counted over all training texts; a text starts after a start symbol and ends with an end token, and its first token has
the bigram only. All levels are sums to one over the vocabulary and one class of unknown words. ``order=2`` leaves the
trigrams out.

Every word gets a number, by falling count within its shard of the vocabulary, so that frequent words have small ones;
with it come its counts, the unigram level. The levels above are a trie of these numbers, split in shards by first word
and slice of what follows it. A shard holds, as flat arrays that can be memory-mapped, the Elias-Fano sequence of its
first words, of the pointers to their first children, of the children (made monotone by adding the rank of the parent,
so that a child is found by a successor search relative to its parent), the same two of the grandchildren, and a
quantised log of every bigram's and trigram's count.

Texts are first cut into blocks of token numbers that carry their own vocabulary. What is shuffled is one message per
block and shard: the distinct words, or bigrams and trigrams, of the block and their training counts. A hot word, context
or n-gram thus occurs once per block however often it is used. The n-grams of a first word are cut in slices in proportion
to its uses in all texts (bigrams by the second word, trigrams by both that follow), so that none holds more than a part
of a shard, however hot it or a pair is; a rare one is in one shard. N-grams with a word that training lacks are known to
be absent and not asked for. Answers return to the blocks, which sum the score of each text.

Cases: a NULL or empty text is the end token alone; a NULL id counts as empty text in the split; repeated rows count
and are scored each; without training texts every token is unknown; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import mix, word_hashes

#: Weight of the next lower level's distribution in that of a context.
DIRICHLET = 20.0
#: Slices of following words in which a context with a shard's mean share of all uses is cut.
SLICES = 4
#: Bytes of text in a block, and blocks whose words one shard answers for (both bound a task's memory).
BLOCK_BYTES = 8 << 20
BLOCKS_PER_SHARD = 1
#: Steps of the quantised log10 counts: 2**16 over 16 orders of magnitude, exact for small counts.
LOG_STEP = 16.0 / 65535

END = int(mix(np.array([0xE0D], np.uint64))[0])
START = int(mix(np.array([0x57A27], np.uint64))[0])


# ---------------------------------------------------------------------------------------------------------------- trie


class EliasFano:
    """A monotone sequence of integers below ``universe``: low bits packed, high bits in unary, all in flat arrays."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.flatnonzero(np.unpackbits(np.asarray(high), bitorder="little"))[:n]
        self._upper = ones - np.arange(n)  # high part of each element
        self._padded = np.concatenate([np.asarray(low), np.zeros(9, np.uint8)])

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        upper = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(int(upper[-1]) + n + 1 if n else 1, np.uint8)
        bits[upper + np.arange(n)] = 1
        low = values & np.uint64((1 << low_bits) - 1)
        packed = []
        for k in range(0, n, 1 << 16):  # so many elements end at a byte, whatever their bits
            planes = np.unpackbits(low[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            packed.append(np.packbits(planes[:, :low_bits].ravel(), bitorder="little"))
        return cls(n, low_bits, np.concatenate(packed) if packed else np.zeros(0, np.uint8),
                   np.packbits(bits, bitorder="little"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<i8")
        return head.tobytes() + np.asarray(self.low).tobytes() + np.asarray(self.high).tobytes()

    @classmethod
    def from_buffer(cls, buffer: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """The sequence that starts at ``at`` of a byte array (a memory map or a message), and where it ends."""
        n, low_bits, a, b = buffer[at:at + 32].view("<i8").tolist()
        at += 32
        return cls(n, low_bits, buffer[at:at + a], buffer[at + a:at + a + b]), at + a + b

    def values(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        index = np.arange(self.n)[at]
        out = self._upper[index].astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = index * self.low_bits
            byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
            window = np.zeros(len(index), np.uint64)
            for k in range(min(8, (self.low_bits + 14) // 8)):  # the bytes that hold the bits, wherever they start
                window |= self._padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
            window >>= shift
            if self.low_bits > 56:
                window |= (self._padded[byte + 8].astype(np.uint64) << np.uint64(1)) << (np.uint64(63) - shift)
            out |= window & np.uint64((1 << self.low_bits) - 1)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element that is at least ``x`` (``n`` if there is none), for many ``x`` at once."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        lo, hi = np.searchsorted(self._upper, high, "left"), np.searchsorted(self._upper, high, "right")
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            below = self.values(mid) < x[open_]
            lo[open_[below]], hi[open_[~below]] = mid[below] + 1, mid[~below]


#: Bits of a word's number, and of a first word, in the sequences.
CHILD_BITS = 32
CONTEXT_BITS = 48
#: Distance of two contexts' first slices before they are mixed: an odd number, so that it is a bijection.
CONTEXT_STEP = 0x9E3779B97F4A7C15


def _quantised(count: np.ndarray) -> np.ndarray:
    """Codes of counts: 0 for none, else 1 and steps of the log."""
    return np.where(count > 0, np.clip(np.rint(np.log10(np.maximum(count, 1)) / LOG_STEP) + 1, 1, 65535), 0).astype("<u2")


def _count(code: np.ndarray) -> np.ndarray:
    """Counts of codes; below 1000 a step is less than one, so that these are exact."""
    count = np.where(code > 0, 10.0 ** (LOG_STEP * (code.astype(np.float64) - 1)), 0.0)
    return np.where(count < 1000, np.rint(count), count)


class TrieLevel(NamedTuple):
    """Children of the nodes of the level above: pointers to the first of each, children, quantised counts."""

    pointers: EliasFano
    children: EliasFano
    bits: int
    codes: np.ndarray

    @classmethod
    def build(cls, parents: int, parent: np.ndarray, child: np.ndarray, count: np.ndarray) -> TrieLevel:
        """From distinct (parent, child) in ascending order; a count of 0 is of a node that only leads on."""
        bits = max(1, int(child.max()).bit_length()) if len(child) else 1
        return cls(EliasFano.encode(np.searchsorted(parent, np.arange(parents + 1)), len(parent) + 1),
                   EliasFano.encode((parent.astype(np.uint64) << np.uint64(bits)) + child, max(1, parents) << bits),
                   bits, _quantised(count))

    def to_bytes(self) -> bytes:
        return (np.array([self.bits], "<i8").tobytes() + self.pointers.to_bytes() + self.children.to_bytes()
                + self.codes.tobytes())

    @classmethod
    def from_buffer(cls, buffer: np.ndarray, at: int) -> tuple[TrieLevel, int]:
        bits = int(buffer[at:at + 8].view("<i8")[0])
        pointers, at = EliasFano.from_buffer(buffer, at + 8)
        children, at = EliasFano.from_buffer(buffer, at)
        return cls(pointers, children, bits, buffer[at:at + 2 * children.n].view("<u2")), at + 2 * children.n

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Place of each (parent, child), -1 where there is none or the parent is -1."""
        out = np.full(len(parent), -1)
        there = np.flatnonzero((parent >= 0) & (child >> np.uint64(self.bits) == 0))
        rank = parent[there]
        want = (rank.astype(np.uint64) << np.uint64(self.bits)) + child[there]
        at = self.children.successor(want)
        inside = (at >= self.pointers.values(rank)) & (at < self.pointers.values(rank + 1))
        at, there = at[inside], there[inside]
        found = self.children.values(at) == want[inside]
        out[there[found]] = at[found]
        return out

    def code(self, at: np.ndarray) -> np.ndarray:
        """Codes of places that ``find`` gave, 0 for none."""
        return np.where(at >= 0, np.append(self.codes, np.uint16(0))[at], 0).astype("<u2")


class TrieShard(NamedTuple):
    """First words of one shard, their children and grandchildren."""

    contexts: EliasFano
    bigrams: TrieLevel
    trigrams: TrieLevel

    @classmethod
    def build(cls, contexts: np.ndarray, parent: np.ndarray, child: np.ndarray, count: np.ndarray, owner: np.ndarray,
              grandchild: np.ndarray, count3: np.ndarray) -> TrieShard:
        """Of the n-grams with counts above 0, and what leads to them.

        From ascending ``contexts``, (parent, child) and (owner, grandchild); a parent is a place in ``contexts``, an
        owner one among the children."""
        some = np.flatnonzero(count3 > 0)
        leads = np.zeros(len(child), bool)
        leads[owner[some]] = True
        kept = np.flatnonzero((count > 0) | leads)
        first, rank = np.unique(parent[kept], return_inverse=True)
        place = np.zeros(len(child), np.int64)
        place[kept] = np.arange(len(kept))
        return cls(EliasFano.encode(contexts[first], 1 << CONTEXT_BITS),
                   TrieLevel.build(len(first), rank, child[kept], count[kept]),
                   TrieLevel.build(len(kept), place[owner[some]], grandchild[some], count3[some]))

    def to_bytes(self) -> bytes:
        return self.contexts.to_bytes() + self.bigrams.to_bytes() + self.trigrams.to_bytes()

    @classmethod
    def from_buffer(cls, buffer: np.ndarray) -> TrieShard:
        """Levels as views of a byte array: of a message, or of ``np.memmap(path, np.uint8, "r")``."""
        contexts, at = EliasFano.from_buffer(buffer, 0)
        bigrams, at = TrieLevel.from_buffer(buffer, at)
        return cls(contexts, bigrams, TrieLevel.from_buffer(buffer, at)[0])

    def codes(self, contexts: np.ndarray, parent: np.ndarray, child: np.ndarray, owner: np.ndarray,
              grandchild: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the counts of bigrams and trigrams, given as in ``build``."""
        rank = self.contexts.successor(contexts).astype(np.int64)
        there = np.flatnonzero(rank < self.contexts.n)
        found = np.full(len(contexts), -1)
        same = self.contexts.values(rank[there]) == contexts[there]
        found[there[same]] = rank[there[same]]
        at = self.bigrams.find(found[parent], child)
        return self.bigrams.code(at), self.trigrams.code(self.trigrams.find(at[owner], grandchild))


# ------------------------------------------------------------------------------------------------------------ messages


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message; numbers are split in byte planes, which compress well when sorted."""
    import zstandard

    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(f"{a.dtype.str}{len(a)};".encode() + a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(message: bytes) -> list[np.ndarray]:
    import zstandard

    data, out, at = zstandard.ZstdDecompressor().decompress(message), [], 0
    while at < len(data):
        end = data.index(b";", at)
        kind, n = np.dtype(data[at:at + 3].decode()), int(data[at + 3:end])
        at = end + 1 + n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * kind.itemsize, end + 1)
                                        .reshape(kind.itemsize, n).T).view(kind).ravel())
    return out


def _deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8")


def _undelta(deltas: np.ndarray) -> np.ndarray:
    return np.cumsum(deltas, dtype=np.uint64)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


# -------------------------------------------------------------------------------------------------------------- blocks


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of texts as token numbers: doc (ids, in training, tokens per text) and words (the block's sorted
    vocabulary, its counts in training and in other texts, the token sequence as numbers in it)."""

    def block(ids: list, train: list, texts: list) -> dict:
        words, n = word_hashes(texts)
        ends = np.cumsum(n + 1) - 1
        tokens = np.full(len(words) + len(texts), END, np.uint64)
        keep = np.ones(len(tokens), bool)
        keep[ends] = False
        tokens[keep] = words
        vocab, number = np.unique(tokens, return_inverse=True)
        train = np.array(train, bool)
        trains = np.repeat(train, n + 1)
        count, other = (np.bincount(number[some], minlength=len(vocab)) for some in (trains, ~trains))
        none = np.array([i is None for i in ids], bool)
        return {"docs": _pack(np.array([i or 0 for i in ids], "<i8"), none.astype("|u1"), train.astype("|u1"),
                              (n + 1).astype("<i8")),
                "vocab": _pack(_deltas(vocab), count.astype("<u4"), other.astype("<u4")), "tokens": _pack(number.astype("<u4")),
                "n_tokens": len(tokens)}

    schema = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("vocab", pa.binary()), ("tokens", pa.binary()),
                        ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, train, texts, size = [], [], [], 0
        at = TaskContext.get().partitionId() << 32  # the blocks are written once, so their numbers stay
        for b in batches:
            for i, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = x.as_py() or ""
                ids.append(i)
                train.append(t)
                texts.append(x)
                size += len(x)
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pylist([{"block": at} | block(ids, train, texts)], schema)
                    at += 1
                    ids, train, texts, size = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([{"block": at} | block(ids, train, texts)], schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "train", F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "block long, docs binary, vocab binary, tokens binary, n_tokens long"))


_ASK = "shard int, block long, message binary"


def _ask(blocks: DataFrame, columns: list[str], message) -> DataFrame:
    """One row per block and shard, from ``message(block row) -> {shard: bytes}``."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("message", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                for shard, data in message(row):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([row["block"]], pa.int64()),
                                                      pa.array([data], pa.binary())], schema=schema)

    return blocks.select("block", *columns).mapInArrow(run, _ASK)


def _answer(asked: DataFrame, shards: int, respond) -> DataFrame:
    """Each shard's messages together, answered by ``respond([messages]) -> [answers]`` in the same order."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("message", pa.binary())])

    def run(held: pa.Table) -> pa.Table:
        held = held.sort_by("block")
        answers = respond(held.column("message").to_pylist())
        return pa.Table.from_arrays([held.column("shard"), held.column("block"), pa.array(answers, pa.binary())],
                                    schema=schema)

    return asked.groupBy("shard").applyInArrow(run, _ASK)


def _returned(answers: DataFrame, name: str) -> DataFrame:
    """All answers to a block, by shard."""
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "message"))).alias(name))


# --------------------------------------------------------------------------------------------------------------- model


def _split(values: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Indices of sorted ``values`` per shard, in order."""
    at = _shard(values, shards)
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    return [(int(at[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def _global_counts(messages: list[bytes]) -> list[bytes]:
    """Sums of both counts over all blocks, returned in each block's own order, with the shard's distinct words between,
    and each word's rank in the shard by training count."""
    own = [_unpack(m) for m in messages]
    keys = [_undelta(k) for k, _, _ in own]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total, other = (np.bincount(at, weights=np.concatenate([o[i] for o in own]).astype(np.float64), minlength=len(every))
                    for i in (1, 2))
    known = np.array([np.count_nonzero(total)], "<u8")
    rank = np.empty(len(every), "<u4")
    rank[np.argsort(-total, kind="stable")] = np.arange(len(every))
    return [_pack(total[i].astype("<u8"), known, other[i].astype("<u8"), rank[i])
            for i in np.split(at, np.cumsum([len(k) for k in keys])[:-1])]


def _gather(messages: list[dict], order: list[tuple[int, np.ndarray]], n: int, part: int) -> np.ndarray:
    """A part of the answers of all shards, back in the order of the questions."""
    out = np.zeros(n)
    for m, (shard, at) in zip(messages, order, strict=True):
        assert m["shard"] == shard
        out[at] = _unpack(m["message"])[part]
    return out


class Grams(NamedTuple):
    """Distinct n-grams of a block, ascending, as places: a bigram of two words (``start`` stands for the start symbol), a
    trigram of the bigram that it begins and the one that it ends with. ``place`` and ``place3`` are those of all tokens
    and of the tokens ``inner``, which have two before them; counts are those in training."""

    context: np.ndarray
    word: np.ndarray
    place: np.ndarray
    count: np.ndarray
    first: np.ndarray
    second: np.ndarray
    inner: np.ndarray
    place3: np.ndarray
    count3: np.ndarray


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each key's place among them."""
    every, place = np.unique(keys, return_inverse=True)
    return every, place.astype(np.int32)


def _ngrams(token: np.ndarray, n: np.ndarray, train: np.ndarray, start: int, order: int) -> Grams:
    """N-grams of texts of ``n`` tokens each, numbered below ``start``."""
    begins = np.cumsum(n) - n
    trains = np.repeat(train.astype(bool), n)
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[begins] = start
    key, place = _distinct(context.astype(np.int64) * (start + 1) + token)
    del context
    inside = np.full(len(token), order > 2)
    inside[begins] = False
    inner = np.flatnonzero(inside)
    key3, place3 = _distinct(place[inner - 1].astype(np.int64) * len(key) + place[inner])
    small = lambda a: a.astype(np.int32)
    return Grams(small(key // (start + 1)), small(key % (start + 1)), place,
                 small(np.bincount(place[trains], minlength=len(key))), small(key3 // len(key)), small(key3 % len(key)),
                 small(inner), place3, small(np.bincount(place3[trains[inner]], minlength=len(key3))))


def _slices(uses: np.ndarray, all_uses: int, shards: int) -> np.ndarray:
    return np.ceil(SLICES * shards / all_uses * uses).astype(np.uint64)


def _bigram_questions(context: np.ndarray, word: np.ndarray, vocab: np.ndarray, total: np.ndarray, uses: np.ndarray,
                      all_uses: int, shards: int):
    """Numbers of the bigrams' words, and the bigrams to ask for, by shard and in their own order.

    The upper half of a word's entry in ``vocab`` is its number. ``total`` and ``uses`` are the counts of ``vocab`` and of
    the start symbol in training and in all texts."""
    numbers = np.append(vocab, np.uint64(START))
    c = numbers[context] >> np.uint64(64 - CONTEXT_BITS)
    w = (numbers >> np.uint64(64 - CHILD_BITS)).astype(np.uint32)[word]
    shard = _shard(mix(c * np.uint64(CONTEXT_STEP) + w % _slices(uses, all_uses, shards)[context]), shards)
    asked = np.flatnonzero((total[context] > 0) & (total[word] > 0))
    order = asked[np.argsort(shard[asked], kind="stable")]
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return c, w, [(int(shard[p[0]]), p) for p in np.split(order, cuts) if len(p)]


class Questions(NamedTuple):
    """What a block asks: nodes by shard, each a bigram of the block with the trigrams asked below it. A node is asked for
    itself if it is in ``own`` (whose bigrams are ``bigrams``), else it only leads to trigrams of its shard."""

    c: np.ndarray
    w: np.ndarray
    shard: np.ndarray
    node: np.ndarray
    own: np.ndarray
    bigrams: np.ndarray
    trigrams: np.ndarray
    n_trigrams: np.ndarray


def _questions(g: Grams, vocab: np.ndarray, total: np.ndarray, uses: np.ndarray, all_uses: int, shards: int) -> Questions:
    """Arguments as those of ``_bigram_questions``."""
    c, w, order = _bigram_questions(g.context, g.word, vocab, total, uses, all_uses, shards)
    known = (total[g.context] > 0) & (total[g.word] > 0)
    asked = np.flatnonzero(known[g.first] & known[g.second])
    first = g.first[asked]
    rest = mix((w[first].astype(np.uint64) << np.uint64(32)) | w[g.second[asked]])
    rest %= _slices(uses, all_uses, shards)[g.context[first]]
    shard = _shard(mix(c[first] * np.uint64(CONTEXT_STEP) + rest), shards)
    del first, rest
    by_shard = np.argsort(shard, kind="stable")
    trigrams = asked[by_shard].astype(np.int32)
    lead = shard[by_shard] * len(c) + g.first[trigrams]
    del shard, by_shard, asked
    bigrams = np.concatenate([at for _, at in order]) if order else np.zeros(0, np.int64)
    own = np.repeat(np.array([s for s, _ in order], np.int64), [len(at) for _, at in order]) * len(c) + bigrams
    nodes = np.unique(np.concatenate([own, lead]))
    small = lambda a: a.astype(np.int32)
    return Questions(c, w, small(nodes // len(c)), small(nodes % len(c)), small(np.searchsorted(nodes, own)), small(bigrams),
                     trigrams, small(np.diff(np.searchsorted(lead, nodes), append=len(lead))))


def _messages(g: Grams, q: Questions) -> Iterator[tuple[int, bytes]]:
    """Each shard's nodes by first word, with their trigrams, and the block's training counts."""
    count = np.zeros(len(q.node), "<u4")
    count[q.own] = g.count[q.bigrams]
    ends = np.cumsum(q.n_trigrams)
    for at in np.split(np.arange(len(q.node)), np.flatnonzero(np.diff(q.shard)) + 1):
        if len(at):
            a, b = at[0], at[-1] + 1
            own = q.c[q.node[a:b]]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            below = q.trigrams[ends[a] - q.n_trigrams[a]:ends[b - 1]]
            yield int(q.shard[a]), _pack(_deltas(own[new]), np.diff(np.append(new, len(own))).astype("<u4"),
                                         q.w[q.node[a:b]].astype("<u4"), count[a:b], q.n_trigrams[a:b].astype("<u4"),
                                         q.w[g.second[below]].astype("<u4"), g.count3[below].astype("<u4"))


def _counts(messages: list[bytes]) -> list[bytes]:
    """Build the shard's trie from the training counts of all blocks, and look up every n-gram of every block."""
    own = [_unpack(m) for m in messages]
    n_nodes, n_grams = ([len(o[i]) for o in own] for i in (2, 5))
    context = np.concatenate([_undelta(o[0]) for o in own])
    n_children, child, count, n_trigrams, grandchild, count3 = (np.concatenate(p) for p in list(zip(*own, strict=True))[1:])
    del own
    contexts, rank = np.unique(context, return_inverse=True)
    shift = np.uint64(CHILD_BITS)
    nodes, at = np.unique((np.repeat(rank.astype(np.uint64), n_children) << shift) + child, return_inverse=True)
    total = np.bincount(at, weights=count, minlength=len(nodes))
    grams, at3 = np.unique((np.repeat(at.astype(np.uint64), n_trigrams) << shift) + grandchild, return_inverse=True)
    total3 = np.bincount(at3, weights=count3, minlength=len(grams))
    del context, rank, n_children, child, count, n_trigrams, grandchild, count3
    low = np.uint64((1 << CHILD_BITS) - 1)
    parent, child = (nodes >> shift).astype(np.int64), nodes & low
    owner, grandchild = (grams >> shift).astype(np.int64), grams & low
    del nodes, grams
    built = TrieShard.build(contexts, parent, child, total, owner, grandchild, total3)
    del total, total3
    trie = TrieShard.from_buffer(np.frombuffer(built.to_bytes(), np.uint8))
    del built
    code, code3 = trie.codes(contexts, parent, child, owner, grandchild)
    return [_pack(code[i], code3[j]) for i, j in zip(np.split(at, np.cumsum(n_nodes)[:-1]),
                                                     np.split(at3, np.cumsum(n_grams)[:-1]), strict=True)]


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def score_documents(docs: DataFrame, mass: float = DIRICHLET, block_bytes: int = BLOCK_BYTES, order: int = 2) -> DataFrame:
    """Base and model log10 probability of every text of ``docs`` (doc_id, text, train), by n-grams of up to ``order``
    words (2 or 3)."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    blocks = stored(_blocks(docs, block_bytes), "lm-blocks")
    size = blocks.agg(F.count("*").alias("blocks"), F.sum("n_tokens").alias("tokens")).first()
    if not size["blocks"]:
        return docs.sparkSession.createDataFrame([], SCORED)
    shards = max(6, -(-size["blocks"] // BLOCKS_PER_SHARD))

    def ask_words(row):
        delta, count, other = _unpack(row["vocab"])
        vocab = _undelta(delta)
        for shard, at in _split(vocab, shards):
            yield shard, _pack(_deltas(vocab[at]), count[at], other[at])

    words = stored(_answer(_ask(blocks, ["vocab"], ask_words), shards, _global_counts), "lm-words")

    # N and V: training tokens of all blocks, and distinct training words of all shards, which every answer tells
    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int(_unpack(m)[1].sum(dtype=np.uint64)) for m in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    n_train = blocks.select("vocab").mapInArrow(second, "n long").agg(F.sum("n")).first()[0]
    n_vocab = (words.groupBy("shard").agg(F.min_by("message", "block").alias("message")).select("message")
               .mapInArrow(second, "n long").agg(F.sum("n")).first()[0])
    n_starts = docs.agg(F.count_if("train"), F.count("*")).first()
    floor = 1.0 / (n_train + n_vocab + 1)
    known = blocks.join(_returned(words, "counts"), "block")

    def grams(row):
        """Texts, tokens by ascending number of the word, counts, n-grams and questions of a block."""
        ids, none, train, n = _unpack(row["docs"])
        vocab = _undelta(_unpack(row["vocab"])[0])
        split = _split(vocab, shards)
        total, other, rank = (_gather(row["counts"], split, len(vocab), part) for part in (0, 2, 3))
        number = rank.astype(np.uint64) * np.uint64(shards) + _shard(vocab, shards).astype(np.uint64)
        if int(number.max()) >> CHILD_BITS:
            raise ValueError("more words than numbers of 32 bits")
        by_number = np.argsort(number)
        place = np.empty(len(vocab), np.int32)
        place[by_number] = np.arange(len(vocab))
        token = place[_unpack(row["tokens"])[0]]
        total, other = total[by_number], other[by_number]
        g = _ngrams(token, n, train, len(vocab), order)
        every, uses = np.append(total, n_starts[0]), np.append(total + other, n_starts[1])
        q = _questions(g, number[by_number] << np.uint64(64 - CHILD_BITS), every, uses, size["tokens"], shards)
        return ids, none, train, n, token, every, g, q

    def ask_grams(row):
        *_, g, q = grams(row)
        yield from _messages(g, q)

    asked = _ask(known, ["docs", "vocab", "tokens", "counts"], ask_grams)
    found = _answer(asked, shards, _counts)
    full = known.join(_returned(found, "found"), "block", "left")  # a block may have nothing to ask
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                        ("score", pa.float64())])

    def scored(row):
        ids, none, train, n, token, total, g, q = grams(row)
        answers = [(m["shard"], *_unpack(m["message"])) for m in row["found"] or []]  # by shard, as the nodes are
        assert [a[0] for a in answers] == np.unique(q.shard).tolist()
        count, count3 = np.zeros(len(g.context)), np.zeros(len(g.first))
        if answers:
            code, code3 = (np.concatenate([a[k] for a in answers]) for k in (1, 2))
            count[q.bigrams], count3[q.trigrams] = _count(code[q.own]), _count(code3)
        del answers, q
        n_context, total = total[g.context], total[:-1]
        unigram = (total + 1) * floor
        p = (count + mass * unigram[g.word]) / (n_context + mass)
        logs = np.log10(p)[g.place]
        logs[g.inner] = np.log10((count3 + mass * p[g.second]) / (count[g.first] + mass))[g.place3]
        first = np.cumsum(n) - n
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64(), mask=none.astype(bool)), pa.array(~train.astype(bool)), pa.array(n),
            pa.array(np.add.reduceat((total > 0)[token].astype(np.int64), first)),
            pa.array(np.full(len(ids), n_train, np.int64)),
            pa.array(np.add.reduceat(np.log10(unigram)[token], first)),
            pa.array(np.add.reduceat(logs, first))], schema=schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield scored(b.slice(i, 1).to_pylist()[0])

    return full.select("block", "docs", "vocab", "tokens", "counts", "found").mapInArrow(score, SCORED)
