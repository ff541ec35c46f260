"""Circulant MinHash: one permutation spreads the shingles, a second one, shifted by k, gives coordinate k.

A shingle's hash is cut to an index of a universe of 2**20 places; SIGMA moves it, and
coordinate k of a set is the least PI[(SIGMA[i] + k) mod 2**20] over its shingles.  Two
stored permutations therefore stand in for any number of independent ones.
"""

from __future__ import annotations

import numpy as np

from tokenloom.llm.textual import mix

UNIVERSE_BITS = 20
_SEED = 20260
_TABLES: list[np.ndarray] = []


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """SIGMA, and PI twice in a row, made once in each process from a fixed seed."""
    if not _TABLES:
        rng = np.random.Generator(np.random.PCG64(_SEED))
        for _ in range(2):
            _TABLES.append(rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32))
        _TABLES[0] = _TABLES[0].astype(np.int64)
        _TABLES[1] = np.concatenate([_TABLES[1], _TABLES[1]])  # its second half makes every shift a view
    return _TABLES[0], _TABLES[1]


def signatures(values: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates for each set; ``first`` cuts ``values`` into sets, none of them empty."""
    sigma, pi = permutations()
    at = sigma[(values >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    out = np.empty((len(first) - 1, size), dtype=np.uint32)
    moved = np.empty(len(at), dtype=np.uint32)
    for k in range(size):
        np.take(pi[k : k + (1 << UNIVERSE_BITS)], at, out=moved, mode="clip")
        out[:, k] = np.minimum.reduceat(moved, first[:-1])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; band number and all its coordinates enter it."""
    out = np.empty((len(signature), bands), dtype=np.int64)
    for band in range(bands):
        acc = np.full(len(signature), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + signature[:, k].astype(np.uint64))
        out[:, band] = acc.view(np.int64)
    return out
