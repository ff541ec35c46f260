"""Word and shingle hashes, tokenization and components against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import bpe
from tokenloom.llm.components import connected_components
from tokenloom.llm.scratch import Scratch
from tokenloom.llm.textual import blocks, distinct_per_text, shingles, string_buffers, words_of

TEXTS = ["", None, " \t\n", "one", "one two", "One TWO three", "É é x", "a  b\x0bc\x0cd\re", "a\xa0b c", "same same same same", "x" * 5000]


def plain_words(t):
    return (t or "").encode().lower().split()


def test_words():
    w = words_of(*string_buffers(pa.array(TEXTS)))
    names: dict[bytes, int] = {}
    for t, text in enumerate(TEXTS):
        own = w.hashes[w.first[t] : w.first[t + 1]].tolist()
        assert len(own) == len(plain_words(text))
        for word, h in zip(plain_words(text), own, strict=True):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingles(k):
    rng = random.Random(k)
    texts = TEXTS + [" ".join(rng.choices("abcd", k=rng.randrange(12))) for _ in range(200)]
    sets = distinct_per_text(*shingles(words_of(*string_buffers(pa.array(texts))), k))
    seen: dict[tuple, set] = {}
    for text, got in zip(texts, sets, strict=True):
        words = plain_words(text)
        want = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
        assert len(got) == len(want)
        seen.setdefault(frozenset(want), set()).add(got.tobytes())
    assert all(len(x) == 1 for x in seen.values())


def library_ids(encoder, texts):
    return [np.array(x.ids, dtype="<u2").tobytes() for x in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encode(encoder, texts):
    offsets, data = string_buffers(pa.array(texts, type=pa.string()))
    out = []
    for low, high in blocks(offsets, 400):
        ids, first = encoder.encode(offsets[low : high + 1], data[offsets[low] : offsets[high]])
        out += [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def test_ids_are_the_librarys():
    rng = random.Random(5)
    letters = list("ab'sSté×!<|2 \n\x1c²Éx½漢") + ["'re", "'LL", "<|endoftext|>", "é"]
    texts = TEXTS + ["don't I'LL", "<|endoftext|> a<|startoftext|>", "!!'s '' 'se"] + ["".join(rng.choices(letters, k=rng.randrange(16))) for _ in range(3000)]
    small = bpe.BlockEncoder(bpe.default_vocabulary(), cache_size=10)
    assert encode(small, texts) == library_ids(small, texts)
    assert len(small.cache) == 10


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (None, 3), (100, 101)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] and None not in e for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def thue_morse(n, a="a", b="b"):
    """A word and its complement, which polynomial hashes modulo 2**64 take for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_made_to_collide():
    one, other = thue_morse(2048)
    w = words_of(*string_buffers(pa.array([one, other, one.upper()])))
    assert w.hashes[0] == w.hashes[2] != w.hashes[1]
    block = bpe.BlockEncoder(bpe.default_vocabulary())
    assert encode(block, [one, other, f"{other} {one}"]) == library_ids(block, [one, other, f"{other} {one}"])
    one, other = (x.split(",") for x in thue_morse(2048, "a,", "b,"))
    from tokenloom.llm.passages import _sequence_ids

    spans = words_of(*string_buffers(pa.array([" ".join(one), " ".join(other)])))
    assert len({tuple(x) for x in _sequence_ids(spans.hashes, spans.first[:-1], spans.first[1:]).tolist()}) == 2


def test_long_texts_are_cut():
    """Words, ids and scores of a text of several blocks are those of the whole."""
    rng = random.Random(7)
    parts = [" ".join("".join(rng.choices("abcdefgé", k=rng.randrange(1, 9))) for _ in range(1000)) for _ in range(8)]
    long = " ".join(rng.choice(parts) for _ in range(600)) + " " + "x" * 2_000_000
    texts = ["one two", long, "three"]
    w = words_of(*string_buffers(pa.array(texts)))
    assert np.diff(w.first).tolist() == [2, len(long.split()), 1]
    names: dict[str, int] = {}
    assert all(names.setdefault(x, h) == h for x, h in zip(long.split(), w.hashes[2:-1].tolist(), strict=True)) and len(set(names.values())) == len(names)
    short = [*texts[:1], long[: 3 << 20], "three"]
    block = bpe.BlockEncoder(bpe.default_vocabulary())
    ids, first = block.encode(*string_buffers(pa.array(short)))
    assert [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)] == library_ids(block, short)


def test_scores_are_convolutions():
    from tokenloom.llm import toxicity as T

    rng = np.random.default_rng(3)
    filters = {w: rng.standard_normal((w, T.DIMENSIONS, T.FILTERS)).astype(np.float32) for w in T.WIDTHS}
    model = T.Model(rng.standard_normal((1 << T.BUCKETS_BITS, T.DIMENSIONS)).astype(np.float32), filters, np.zeros(24, np.float32), np.ones(24, np.float32))
    sizes = [0, 1, 2, 7, T.LONG + 5]
    rows = rng.integers(0, 1 << T.BUCKETS_BITS, size=(sum(sizes), 2))
    first = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes):
        own = rows[first[i] : first[i + 1]]
        x = np.concatenate([model.table[own[:, 0]] + model.table[own[:, 1]], np.zeros((3, T.DIMENSIONS), np.float32)])
        want = np.concatenate([sum(x[o : n + 3 - w + 1 + o] @ filters[w][o] for o in range(w)).max(axis=0) for w in T.WIDTHS])
        assert np.allclose(model._longest(own, np.array([0, n]))[0], want, atol=1e-4)
    assert np.allclose(model.maxima(rows, first)[:-1], np.concatenate([model._longest(rows[a:b], np.array([0, b - a])) for a, b in zip(first[:-2], first[1:-1], strict=True)]), atol=1e-4)
