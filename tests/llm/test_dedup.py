"""Near-duplicates, passages and decontamination against brute force and planted cases."""

from __future__ import annotations

import random
import string

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm.decontaminate import clean, contaminated, tile
from tokenloom.llm.minhash import band_keys, signatures
from tokenloom.llm.near_dedup import near_duplicates
from tokenloom.llm.passages import BANDS, ROWS, repeats, without_repeats
from tokenloom.llm.textual import string_buffers, windows, words_of

SCHEMA = "doc_id long, text string, cid string, key string, score string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "c", None, "s") for d, t in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 7))) for _ in range(n))][0]


def brute(rows, k, num, den):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and rows[a][0] is not None and rows[b][0] is not None and den * both >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least[find(i)] if d is not None else None), d is not None and least[find(i)] == d) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(4)
    rows = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (None, "one two"), (905, "a"), (906, "x" * 70_000)]
    boiler = prose(rng, 40)
    for i in range(60):  # short texts that share most of their words and are no copies
        rows.append((i, boiler + " " + prose(rng, 25)))
    base = prose(rng, 120).split()
    for i in range(60, 140):  # copies with edits of their own, around the threshold
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        rows.append((i, " ".join(w)))
    for i in range(140, 160):
        rows.append((i, " ".join(base)))
    rows += [(300, prose(rng, 3000)), (65, rows[70][1]), (60, rows[8 + 60][1])]
    return rows


def test_near_duplicates(spark, near_rows):
    got = near_duplicates(frame(spark, near_rows), 3, (85, 100)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(near_rows, 3, 85, 100)


def test_large_family(spark):
    """Copies with edits and losses of their own: many are too far from every centre and share common shingles only."""
    rng = random.Random(1)
    base, rows = prose(rng, 120).split(), []
    for i in range(600):
        head, tail = (0, 0) if i < 150 else (rng.randrange(0, 22), rng.randrange(0, 22))
        w = base[head : len(base) - tail]
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(frame(spark, rows), 3, (85, 100)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, 3, 85, 100)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def tile_by_hand(text, pattern, least):
    used_t, used_p, tiles = [False] * len(text), [False] * len(pattern), []
    while True:
        best, found = 0, []
        for j in range(len(pattern)):
            for i in range(len(text)):
                n = 0
                while i + n < len(text) and j + n < len(pattern) and text[i + n] == pattern[j + n] and not used_t[i + n] and not used_p[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(j, i)]
                elif n and n == best:
                    found.append((j, i))
        if best < least:
            return sorted(tiles)
        for j, i in found:
            if not any(used_t[i : i + best]) and not any(used_p[j : j + best]):
                used_t[i : i + best] = used_p[j : j + best] = [True] * best
                tiles.append((i, j, best))


@pytest.mark.parametrize("seed", range(60))
def test_tiling(seed):
    rng = random.Random(seed)
    letters = range(rng.choice([2, 3, 8]))
    text, pattern = (rng.choices(letters, k=rng.randrange(n)) for n in (40, 25))
    if seed % 2 and len(pattern) > 6:
        cut = rng.randrange(len(pattern))
        text = text + pattern[cut:] + pattern[:cut]
    assert sorted(tile(np.array(text, dtype=np.uint64), np.array(pattern, dtype=np.uint64), 3)) == tile_by_hand(text, pattern, 3)


def test_contaminated(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 40)) for i in range(5)] + [(5, None), (6, ""), (7, "too short"), (0, "")]
    words = items[1][1].split()
    moved = " ".join(words[20:] + [prose(rng, 5)] + words[:20])
    part = " ".join(words[:12])
    rows = [(1, prose(rng, 50) + " " + items[0][1].upper() + ", " + prose(rng, 9)), (2, prose(rng, 200)), (3, moved), (4, part), (5, None), (6, ""), (None, items[2][1]), (7, "too short"), (1, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    for block_words in (10**6, 10):
        got = contaminated(docs, bench, block_words=block_words).collect()
        assert sorted((str(r.doc_id), r.item_id) for r in got) == [("1", 0), ("1", 0), ("3", 1), ("None", 2)]
        assert sorted(str(r.doc_id) for r in clean(docs, bench, block_words=block_words).collect()) == sorted(str(x) for x in (2, 4, 5, 6, 7))
    assert contaminated(frame(spark, []), bench).count() == 0
    assert contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_paragraphs_at_the_threshold(spark):
    """Pairs just above 0.8 that share a bucket: none is dropped for a signature that agrees little."""
    rng = random.Random(11)
    rows, groups = [], 1500
    for g in range(groups):
        w = prose(rng, 104).split()
        rows.append((2 * g, " ".join(w)))
        w[19], w[60] = "edita", "editb"  # 90 shingles of 110 in common
        rows.append((2 * g + 1, " ".join(w)))
    keys = {d: set(band_keys(signatures(x := np.unique(windows(words_of(*string_buffers(pa.array([t]))).hashes, 5)), np.array([0, len(x)]), BANDS * ROWS), BANDS, ROWS)[0].tolist()) for d, t in rows}
    want = {g for g in range(groups) if keys[2 * g] & keys[2 * g + 1]}
    got = {r.doc_id // 2 for r in repeats(frame(spark, rows)).collect() if r.kind == "paragraph" and r.removed}
    assert got == want


def test_passages(spark):
    rng = random.Random(2)
    rows, planted = [], {}
    for i in range(60):
        rows.append([i, "\n".join(prose(rng, rng.randrange(20, 90)) for _ in range(4))])
    for p in range(12):
        passage = prose(rng, rng.randrange(52, 70))
        planted[p] = passage
        for d in range(p * 3, p * 3 + 3):
            w = rows[d][1].split(" ")
            at = rng.randrange(len(w))
            rows[d][1] = " ".join([*w[:at], passage, *w[at:]])
    paragraph = prose(rng, 60).split()
    for d in (40, 41, 42):  # one paragraph with an edit near its end
        w = list(paragraph)
        w[-2] = f"edit{d}"
        rows[d][1] += "\n" + " ".join(w)
    for d in range(45, 60):  # common short lines are no passages
        rows[d][1] += "\nThis line of nine words is in many texts"
    rows += [[100, None], [101, ""], [None, rows[0][1]], [50, rows[50][1]]]
    docs = frame(spark, [tuple(r) for r in rows])
    found = repeats(docs).collect()
    assert {r.doc_id for r in found if r.removed} == {p * 3 + k for p in planted for k in (1, 2)} | {41, 42}
    assert {r.doc_id for r in found} == set(range(36)) | {40, 41, 42}
    out = without_repeats(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert len(texts) == 62 and texts[100] is None and texts[101] == ""
    for p, passage in planted.items():
        assert sum(passage in texts[d] for d in range(p * 3, p * 3 + 3)) == 1
    assert all(texts[d] == rows[d][1] for d in [*range(36, 41), *range(43, 60)])
    assert repeats(frame(spark, [])).count() == 0 and without_repeats(frame(spark, [])).count() == 0


def test_passages_are_whole_repeats(spark):
    """Common short lines in an order of their own are no passage; the same lines in the same order are."""
    rng = random.Random(5)
    common = [prose(rng, rng.randrange(2, 8)) for _ in range(60)]
    rows = [(i, "\n".join(rng.sample(common, 30))) for i in range(40)]
    same = "\n".join(rng.sample(common, 20))
    rows += [(i, prose(rng, 40) + "\n" + same + "\n" + prose(rng, 40)) for i in (100, 101, 102)]
    docs = frame(spark, rows)
    found = repeats(docs).collect()
    assert {(r.doc_id, r.removed, r.component_id) for r in found} == {(100, False, 100), (101, True, 100), (102, True, 100)}
    for r in found:  # less some words at either end
        part = dict(rows)[r.doc_id].encode()[r.start : r.end].decode()
        assert part.strip() in same and len(part.split()) == r.words >= len(same.split()) - 14
    texts = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    assert all(texts[i] == t for i, t in rows if i not in (101, 102))


def test_paragraphs_against_all_pairs(spark):
    """Components of a small corpus are those of every pair's exact Jaccard similarity, near the threshold too; the share found is measured."""
    import random

    from tokenloom.llm.passages import repeats

    rng = random.Random(20)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 120))]
        texts.append(base)
        for edits in (1, 1, 2, 2, 3, 4):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(own)
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    sizes = {}
    for x in range(len(texts)):
        sizes.setdefault(find(x), []).append(x)
    want = {x: root for root, own in sizes.items() if len(own) > 1 for x in own}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in repeats(docs).where("kind = 'paragraph'").collect()}
    assert set(got) <= set(want) and all(want[x] == want[root] for x, root in got.items())
    assert len(links) > 150 and sum(got.get(x) == root for x, root in want.items()) >= 0.995 * len(want)
