"""Exact token ids of whole text columns, a distinct pre-token at a time.

A word-end BPE tokenizer splits a normalised text into pre-tokens and encodes each by itself,
so the ids of a text are those of its pre-tokens in a row.  The pre-tokens of a block of
texts are found by array operations, reduced to the distinct ones, and only those that the
worker has not met before are encoded.

White space ends every pre-token, so texts are first cut there.  A chunk of plain letters
(ASCII and the letters of Latin-1), digits and marks is cut here by the tokenizer's pattern;
a chunk with anything else, or with the beginning of a special token's text, stays one
opaque piece for the library, which then normalises and cuts it itself.  Pieces are told apart by a hash, and
the bytes of all are compared with those of the one they were taken for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from tokenloom.llm.textual import blocks, cut_long, mix

#: Distinct pre-tokens a worker remembers (some 200 bytes each); later ones are encoded anew in each block.
CACHE_SIZE = 200_000
#: Begins the key of an opaque piece, and of a pre-token that the library cut out of one; plain ones have no control characters.
MARK, CUT = b"\0", b"\1"
SPACE, LETTER, DIGIT, OTHER, OPAQUE = range(5)
#: What the tokenizer's pattern takes as one pre-token after an apostrophe.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_HASH_BASE = 0x9E3779B97F4A7C15


def _byte_classes() -> np.ndarray:
    c = np.full(256, OPAQUE, dtype=np.uint8)
    c[33:127] = OTHER
    c[[9, 10, 11, 12, 13, 32]] = SPACE
    c[48:58] = DIGIT
    for a in (65, 97):
        c[a : a + 26] = LETTER
    return c


_CLASSES = _byte_classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UP: list[np.ndarray] = []


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _UP or len(_UP[0]) < n:
        _UP.clear()
        for base in (_HASH_BASE, pow(_HASH_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            p[0] = 1
            _UP.append(np.cumprod(p, dtype=np.uint64))
    return _UP[0], _UP[1]


class PreTokens:
    """The pre-tokens of a block: the text each is in, its number among the distinct ones, and those."""

    def __init__(self, text: np.ndarray, number: np.ndarray, distinct: list[bytes]):
        self.text, self.number, self.distinct = text, number, distinct


def _same_bytes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, like: np.ndarray, kind: np.ndarray) -> bool:
    """Whether every piece has the bytes and the kind of the one that it was taken for."""
    size = stop - start
    if (size != size[like]).any() or (kind != kind[like]).any():
        return False
    move = np.repeat((start[like] - start).astype(np.int32), size)
    at = np.arange(len(move), dtype=np.int32) + np.repeat((start - (np.cumsum(size) - size)).astype(np.int32), size)
    own = data[at]
    at += move
    return bool((own == data[at]).all())


def _by_bytes(raw: bytes, start: np.ndarray, stop: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct pieces and their first places, for blocks made so that hashes collide."""
    seen: dict[tuple[bool, bytes], int] = {}
    number = np.array([seen.setdefault((k, raw[a:b]), len(seen)) for k, a, b in zip(kind.tolist(), start.tolist(), stop.tolist(), strict=True)], dtype=np.int64)
    return number, np.unique(number, return_index=True)[1]


def pre_tokens(offsets: np.ndarray, data: np.ndarray) -> PreTokens:
    """Cuts the texts between ``offsets`` in ``data``; a distinct one is its lower-cased bytes, an opaque one MARK and its raw bytes."""
    offsets = offsets - offsets[0]
    size = len(data)
    if not size:
        return PreTokens(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    kind = _CLASSES[data]
    # the letters of Latin-1 are the byte C3 and one of 80-BF but for the multiplication and division signs
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    good = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
    kind[good] = kind[good + 1] = LETTER
    low = _LOWER[data]
    capital = good[data[good + 1] <= 0x9E] + 1
    low[capital] += 32
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    # chunks between white space or text ends; those with an opaque byte or "<|" are opaque
    space = kind == SPACE
    chunk_start = ~space
    chunk_start[1:] &= space[:-1] | edge[1:-1]
    odd = kind == OPAQUE
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    opaque = np.zeros(size, dtype=bool)
    if odd.any():
        chunk = np.cumsum(chunk_start, dtype=np.int32)
        opaque_chunk = np.zeros(int(chunk[-1]) + 1, dtype=bool)
        opaque_chunk[chunk[odd]] = True
        opaque = opaque_chunk[chunk] & ~space
        low[opaque] = data[opaque]
        kind[opaque] = OPAQUE
    begins = chunk_start.copy()
    begins[1:] |= ~space[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    quote = np.flatnonzero(begins[:-1] & (data[:-1] == 39) & (kind[:-1] == OTHER))
    for q in quote:
        tail = low[q + 1 : q + 3].tobytes()
        for c in CONTRACTIONS:
            if tail.startswith(c) and not edge[q + 1 : q + 1 + len(c)].any() and kind[q + 1] == LETTER:
                begins[q + 1] = False
                if q + 1 + len(c) < size and not space[q + 1 + len(c)]:
                    begins[q + 1 + len(c)] = True
                break
    start = np.flatnonzero(begins)
    if not len(start):  # white space only
        return PreTokens(start, start, [])
    last = ~space
    last[:-1] &= begins[1:] | space[1:]
    stop = np.flatnonzero(last) + 1
    up, down = _powers(size + 1)
    total = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
    is_opaque = opaque[start]
    hashes = mix((total[stop] - total[start]) * down[start] + ((stop - start).astype(np.uint64) << np.uint64(1)) + is_opaque.astype(np.uint64))
    number, _ = pd.factorize(hashes)
    first = np.empty(number.max() + 1, dtype=np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    raw = low.tobytes()
    if not _same_bytes(low, start, stop, first[number], is_opaque):
        number, first = _by_bytes(raw, start, stop, is_opaque)
    spans = zip(is_opaque[first].tolist(), start[first].tolist(), stop[first].tolist(), strict=True)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return PreTokens(text, number, [MARK + raw[a:b] if o else raw[a:b] for o, a, b in spans])


class BlockEncoder:
    """Encodes blocks of texts with a word-end BPE vocabulary file."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letters = _byte_letters()
        self.cache: dict[bytes, int] = {}
        self.cache_size = cache_size
        self.flat = np.zeros(1 << 16, dtype=self.dtype)
        self.start = np.zeros(1 << 14, dtype=np.int64)  # of each known pre-token's ids, and where the last one's end
        self.known = 0

    def ids(self, piece: bytes) -> list[int]:
        """The ids of one pre-token or opaque piece."""
        if piece.startswith(CUT):
            return [x.id for x in self.model.tokenize(piece[1:].decode())]
        if piece.startswith(MARK):
            return self.tokenizer.encode(piece[1:].decode(), add_special_tokens=False).ids
        letters = self.letters
        return [x.id for x in self.model.tokenize("".join([letters[b] for b in piece]))]

    def cut(self, piece: bytes) -> list[bytes]:
        """The pre-tokens of an opaque piece, as the library normalises and cuts it; one that may hold a special token's text stays whole."""
        text = piece[1:].decode()
        if "<|" in text:
            return [piece]
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [CUT + x.encode() for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _add(self, ids: list[int]) -> int:
        if self.known + 2 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        low = int(self.start[self.known])
        while low + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[low : low + len(ids)] = ids
        self.known += 1
        self.start[self.known] = low + len(ids)
        return self.known - 1

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block in order, and where each text's begin (one entry more than texts); long texts are encoded in parts."""
        offsets = offsets - offsets[0]
        cuts, owner = cut_long(offsets, data)
        if len(cuts) == len(offsets):
            return self._encode(offsets, data)
        parts, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
        for low, high in blocks(cuts):
            ids, first = self._encode(cuts[low : high + 1], data[cuts[low] : cuts[high]])
            parts.append(ids)
            np.add.at(counts, owner[low:high], np.diff(first))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])

    def _encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, n = pre_tokens(offsets, data), len(offsets) - 1
        if not len(found.number):
            return np.zeros(0, dtype=self.dtype), np.zeros(n + 1, dtype=np.int64)
        settled, cache, slots = self.known, self.cache, []
        for key in found.distinct:
            slot = cache.get(key)
            if slot is None:
                slot = self._add(self.ids(key))
                if len(cache) < self.cache_size:
                    cache[key] = slot
                    settled = self.known
            slots.append(slot)
        slot = np.array(slots)[found.number]
        begin = self.start[slot]
        count = self.start[slot + 1] - begin
        ends = np.cumsum(count)
        out = self.flat[np.repeat(begin - (ends - count), count) + np.arange(ends[-1])]
        per_text = np.bincount(found.text, weights=count, minlength=n).astype(np.int64)
        self.known = settled
        return out, np.concatenate([[0], np.cumsum(per_text)])


_ENCODERS: dict[str, BlockEncoder] = {}


def encoder(path: str) -> BlockEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BlockEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
