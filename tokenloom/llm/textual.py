"""Whole Arrow string columns as word hashes and shingle hashes, without a Python loop over words.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``; A-Z are lower-cased first.  Each
word gets a 64-bit hash, the sum of a random number for each (byte, place in the word), each window of ``k``
words a mixed 64-bit hash of its words.  A text with 1 to ``k - 1`` words has one shingle, the whole sequence; an
empty or null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: As white space, and ASCII punctuation too.
MARKS = _SPACE.copy()
MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: Places of a word whose numbers are kept in a table; those of later ones are made when they are met.
PLACES = 64
_SALT = np.uint64(0x9E3779B97F4A7C15)
_TABLE: list[np.ndarray] = []
#: Bytes of text worked on at once, so that the arrays stay small; longer texts are cut at white space.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    """A random number for each byte at each of the first ``PLACES`` places of a word."""
    if not _TABLE:
        _TABLE.append(mix(np.arange(PLACES << 8, dtype=np.uint64) + _SALT))
    return _TABLE[0]


@dataclass
class Words:
    """The words of a block of texts: hashes, the text each is in, and byte spans in the block."""

    hashes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: Where the words of each text begin; one more entry than texts.
    first: np.ndarray
    #: Where each text begins in the block; one more entry than texts.
    offsets: np.ndarray
    data: np.ndarray
    #: Hashes of each word's first bytes, where they were asked for.
    heads: np.ndarray | None = None


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return at - at[0], np.zeros(0, dtype=np.uint8)
    return at - at[0], np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, one text at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def cut_long(offsets: np.ndarray, data: np.ndarray, limit: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with cuts before white space in texts of over ``limit`` bytes, and the text that each part is of.

    A part is longer than ``limit`` only where it is one word.
    """
    if len(offsets) < 2 or not (np.diff(offsets) > limit).any():
        return offsets, np.arange(len(offsets) - 1)
    cuts: list[int] = []
    owner: list[int] = []
    for t, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = low
        while True:
            cuts.append(at)
            owner.append(t)
            if high - at <= limit:
                break
            nearest = np.flatnonzero(_SPACE[data[at + 1 : at + limit + 1]])
            if len(nearest):
                at += 1 + int(nearest[-1])
                continue
            at = _next_space(data, at + limit, high)
            if at == high:
                break
    return np.array([*cuts, offsets[-1]], dtype=np.int64), np.array(owner)


def _next_space(data: np.ndarray, low: int, high: int) -> int:
    while low < high:
        some = np.flatnonzero(_SPACE[data[low : min(low + BLOCK_BYTES, high)]])
        if len(some):
            return low + int(some[0])
        low += BLOCK_BYTES
    return high


def _words(offsets: np.ndarray, data: np.ndarray, between: np.ndarray, head: int) -> tuple[np.ndarray, ...]:
    """Hashes, begins and ends of the words between ``offsets``, and hashes of their first bytes."""
    low = _LOWER[data]
    space = between[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a word never runs on into the next text
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    size = end - start
    # the place in the word above the byte; bytes between words get numbers too, which no word takes in
    code = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 23 else np.int64)
    code[: start[0] if len(start) else len(data)] = 0
    if len(start):
        code[start[0] :] -= np.repeat(start.astype(code.dtype), np.diff(np.append(start, len(data))))
    far = np.flatnonzero((code >= PLACES) & ~space) if len(size) and size.max() > PLACES else start[:0]
    code <<= 8
    code |= low
    number = np.take(_letters(), code, mode="clip")
    number[far] = mix(code[far].astype(np.uint64) + _SALT)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(number, out=total[1:])
    hashes = mix(total[end] - total[start] + size.astype(np.uint64))
    return hashes, start, end, mix(total[np.minimum(end, start + head)] - total[start]) if head else hashes[:0]


def words_of(offsets: np.ndarray, data: np.ndarray, between: np.ndarray = _SPACE, head: int = 0) -> Words:
    """The words of the texts that ``offsets`` cut out of ``data``; ``between`` marks the bytes outside words.

    Bytes are worked on a block at a time, so that a long text takes some 30 bytes a word and not 60 a byte.
    """
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    cuts, _ = cut_long(offsets, data)
    found = [(cuts[low], *_words(cuts[low : high + 1] - cuts[low], data[cuts[low] : cuts[high]], between, head)) for low, high in blocks(cuts) if cuts[high] > cuts[low]]
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, none, np.zeros(n + 1, dtype=np.int64), offsets, data, none.astype(np.uint64))
    hashes, heads = (np.concatenate([f[k] for f in found]) for k in (1, 4))
    start, end = (np.concatenate([f[0] + f[k] for f in found]) for k in (2, 3))
    first = np.searchsorted(start, offsets, side="left")
    text = np.repeat(np.arange(n), np.diff(first))
    return Words(hashes, text, start, end, first, offsets, data, heads if head else None)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every ``k`` words in a row, across texts too; shorter input gives none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
        acc ^= acc >> np.uint64(29)
    return mix(acc)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes in order of text and place, repeats included, and where each text's begin."""
    n = np.diff(words.first)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)])
    whole = windows(words.hashes, k)
    last = np.clip(np.arange(len(whole)) + k - 1, 0, max(0, len(words.text) - 1))
    inside = words.text[: len(whole)] == words.text[last] if len(whole) else np.zeros(0, dtype=bool)
    out = np.zeros(first[-1], dtype=np.uint64)
    is_long = np.repeat(n >= k, counts)
    out[is_long] = whole[inside]
    for t in np.flatnonzero((n > 0) & (n < k)):
        acc = np.uint64(n[t])
        with np.errstate(over="ignore"):
            for h in words.hashes[words.first[t] : words.first[t + 1]]:
                acc = acc * np.uint64(0xA24BAED4963EE407) + h
        out[first[t]] = mix(np.array([acc]))[0]
    return out, first


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
