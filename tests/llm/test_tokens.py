"""Counts, files and packing against the tokenizer library."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tokenloom.llm.bpe import default_vocabulary
from tokenloom.llm.packing import pack, pack_lengths
from tokenloom.llm.token_counts import token_counts
from tokenloom.llm.token_files import read_token_files, write_token_files

SCHEMA = "doc_id long, text string, n long, ids string, row int"
ROWS = [(5, "Hello world don't", 1, "x", 1), (2, None, 2, "y", 2), (9, "", 3, None, 3), (7, "word " * 9000, 4, "z", 4), (None, "no id here", 5, "a", 5), (5, "Hello world don't", 1, "x", 1), (3, "漢字 <|endoftext|> É", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(default_vocabulary())
    return [t.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS]


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


@pytest.mark.parametrize("head", [0, 2, 100_000])
def test_counts(docs, ids, head):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, head=head).collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), len(i), len(i) > 2048) for r, i in zip(ROWS, ids, strict=True))


def test_files(spark, docs, ids):
    got = sorted(read_token_files(*write_token_files(docs)).collect(), key=lambda r: r.start)
    want = sorted(((r[0] is not None, r[0] or 0, i + [2]) for r, i in zip(ROWS, ids, strict=True)), key=lambda x: x[:2])
    assert [r.doc_id for r in got] == [w[1] if w[0] else None for w in want]
    start = 0
    for r, w in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(w[2]), crc(w[2]))
        start += len(w[2])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_counts(none).count() == 0
    assert read_token_files(*write_token_files(none)).count() == 0
    assert pack(none).count() == 0


def test_pack(docs, ids):
    rows = pack(docs, capacity=1000).collect()
    want = sorted((str(r[0]), p, crc((i + [1])[p * 1000 : p * 1000 + 1000])) for r, i in zip(ROWS, ids, strict=True) for p in range(-(-(len(i) + 1) // 1000)))
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in rows) == want
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1000


def best_fit_one_by_one(lengths, capacity):
    """The same rules a piece at a time: large ones by greedy matching, small ones into the tightest gap."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        b = next((x for x in large if a + x <= capacity), None)
        if b is not None:
            large.remove(b)
        gaps.append(capacity - a - (b or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(6, 60))
    lengths = rng.integers(1, capacity + 1, size=int(rng.integers(0, 200))).tolist()
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs = pack_lengths(histogram, capacity)
    packed = [n for bins, inside in runs for n in inside for _ in range(bins)]
    assert sorted(packed) == sorted(lengths)
    assert all(sum(inside) <= capacity for _, inside in runs)
    bins = sum(b for b, _ in runs)
    assert bins <= best_fit_one_by_one(lengths, capacity) + 1


def test_plan_does_not_grow_with_the_pieces():
    rng = np.random.default_rng(0)
    shape = {int(n): int(c) for n, c in zip(range(1, 4097), rng.integers(1, 50, 4096), strict=True)}
    assert len(pack_lengths({n: 1000 * c for n, c in shape.items()}, 4096)) < 3 * len(pack_lengths(shape, 4096)) + 100


BLANKS = [["   "], ["\n", " ", None], ["", None], [" " * 3_000_000], ["a" + "\t \n" * 1_000_000 + "b", "\r\n"]]


@pytest.mark.parametrize("texts", BLANKS, ids=range(len(BLANKS)))
def test_white_space_only(spark, texts):
    """Tables, batches and long runs of white space count, pack and read back as the library's ids."""
    t = Tokenizer.from_file(default_vocabulary())
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == {i: len(x) for i, x in want.items()}
    assert {r.doc_id: r.ids_crc32 for r in read_token_files(*write_token_files(docs)).collect()} == {i: crc(x + [2]) for i, x in want.items()}
    assert {r.doc_id: r.ids_crc32 for r in pack(docs).collect()} == {i: crc(x + [1]) for i, x in want.items()}
