"""64-bit hashes of words, for many texts at once.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Its hash is a polynomial of its bytes
modulo 2^64, mixed with its length, so that one pass of array operations hashes a whole block of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once; a longer text is cut at white space.
BLOCK = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a block of bytes."""
    b = np.frombuffer(block, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lens = ends - starts
    keep = inside[1:-1].astype(bool)
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    terms = (b[keep].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[place]
    return starts, mix(np.add.reduceat(terms, first) ^ (lens.astype(np.uint64) << np.uint64(48)))


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in blocks that end at white space (or as a whole where it has none)."""
    at = 0
    while len(text) - at > BLOCK:
        end = at + BLOCK
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the number of words of each text; unless ``lower``, of the words
    unchanged."""
    counts, out = np.zeros(len(texts), np.int64), []
    held: list[bytes] = []
    size = first = 0

    def flush(upto: int) -> None:
        nonlocal held, size, first
        if held:
            at = np.cumsum([0] + [len(h) + 1 for h in held])
            starts, hashes = _hash_block(b"\n".join(held))
            counts[first:upto] += np.diff(np.searchsorted(starts, at))
            out.append(hashes)
        held, size, first = [], 0, upto

    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8")
        b = b.lower() if lower else b
        if len(b) > BLOCK:
            flush(i)
            for part in _cut(b):
                hashes = _hash_block(part)[1]
                counts[i] += len(hashes)
                out.append(hashes)
            first = i + 1
            continue
        held.append(b)
        size += len(b)
        if size > BLOCK:
            flush(i + 1)
    flush(len(texts))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(_BASE) + words[k:len(words) - n + 1 + k] + np.uint64(k + 1))
    return h
