"""Archives, containers, the classifier and transcripts: round trips and held-out accuracy."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import media, toxicity, transcripts, warc


def test_monolith_becomes_members():
    records = [warc.record_bytes(i, f"http://x/{i}", bytes([i]) * n, "d", None) for i, n in enumerate([0, 1, 5000, 3 << 20])]
    for raw in (gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)):
        out = io.BytesIO()
        index = list(warc.rewrite(io.BytesIO(raw), out))
        assert [zlib.decompress(out.getvalue()[x["offset"] : x["offset"] + x["length"]], 31) for x in index] == records
    with pytest.raises(ValueError):
        list(warc.rewrite(io.BytesIO(gzip.compress(records[0][:-9])), io.BytesIO()))


def test_archives(spark):
    long = "ä" * 80
    rows = [(3, "http://a", long), (1, "http://b\n c", long), (2, None, "short"), (4, "", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (1, "http://b", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "owner": F.lit(2), "payload": F.lit(3)}).repartition(2)
    uri, files = warc.write_archives(pages)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(uri, warc.normalise(uri, files)).collect())
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and page != 1
        want.append((str(page), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want)
    empty = pages.limit(0)
    uri, files = warc.write_archives(empty)
    assert warc.read_records(uri, warc.normalise(uri, files)).count() == 0


@pytest.mark.parametrize("n", [1, 12, 13, 64, 65, 128, 1000])
def test_container(n):
    payload = np.random.default_rng(n).integers(0, 256, n * media.SAMPLE, dtype=np.uint8).tobytes()
    data = media.store(payload)
    (track,) = media.probe(data)
    assert media.samples(data, track) == payload
    assert (track.codec, track.duration, track.timescale) == ("raw ", n, media.RATE)
    assert np.flatnonzero(track.key).tolist() == list(range(0, n, media.KEY_EVERY))
    top = [path[0] for path, _, _ in media.walk(data) if len(path) == 1]
    assert top == [b"ftyp", b"moov", b"mdat"]


def test_other_containers():
    """Version 1 headers, 32-bit chunk offsets, single sizes, a box that runs to the end."""
    import struct

    table = media.box(
        b"stbl",
        media.full_box(b"stsd", 0, struct.pack(">I", 1), media.box(b"avc1", bytes(78))),
        media.full_box(b"stsc", 0, struct.pack(">I", 2), struct.pack(">6I", 1, 2, 1, 2, 1, 1)),
        media.full_box(b"stsz", 0, struct.pack(">II", 0, 3), struct.pack(">3I", 5, 7, 9)),
        media.full_box(b"stco", 0, struct.pack(">I", 2), struct.pack(">II", 100, 300)),
        media.full_box(b"stss", 0, struct.pack(">I", 1), struct.pack(">I", 2)),
    )
    head = media.full_box(b"mdhd", 1 << 24, bytes(16), struct.pack(">IQ", 1000, 5000), bytes(4))
    data = media.box(b"moov", media.box(b"trak", media.box(b"mdia", head, media.box(b"minf", table)))) + struct.pack(">I4s", 0, b"mdat") + b"x" * 500
    (track,) = media.probe(data)
    assert (track.codec, track.timescale, track.duration) == ("avc1", 1000, 5000)
    assert track.offsets.tolist() == [100, 105, 300] and track.sizes.tolist() == [5, 7, 9] and track.key.tolist() == [False, True, False]
    with pytest.raises(ValueError):
        list(media.walk(data[:40]))


def test_media_column(spark):
    texts = ["", None, "é" * 96, "x" * 193, "x" * 193, "y" * 30_000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "z", 0)], "doc_id long, text string, media int").repartition(2)
    got = {r.doc_id: r for r in media.probe_column(media.media_column(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        data = media.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert all(data[k.offset : k.offset + k.bytes] == payload[192 * 12 * j : 192 * 12 * j + 192] for j, k in enumerate(r.keyframes))
    assert media.probe_column(media.media_column(docs.limit(0))).count() == 0


def labelled(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    bad = ["stupid", "trashy", "wortlos", "vilain"]
    texts, labels, langs = [], [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randrange(3, 200))
        y = int(rng.random() < 0.3)
        for _ in range(2 * y):
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append(y if any(x in bad for x in w) or not y else 0)
        langs.append(["en", "de", None][i % 3])
    return texts, np.array(labels), langs


def test_classifier_on_held_out_rows(spark):
    texts, labels, langs = labelled(1, 900)
    docs = spark.createDataFrame([(i, t, x, "old") for i, (t, x) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, extra string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, where=F.col("doc_id") % 3 != 1)
    rows = toxicity.score(docs, model).collect()
    held = [(r.score, labels[r.doc_id]) for r in rows if r.doc_id % 3 == 1]
    assert all(0 <= s <= 1 for s, _ in held)
    assert np.mean([(s >= toxicity.CUT) == y for s, y in held]) > 0.95
    assert set(model.cuts) <= {"en", "de"}
    again = {r.doc_id: r.score for r in toxicity.score(docs.repartition(3), model).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-4 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (3, "word " * 30_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(odd.limit(0), model).count() == 0
    clash = odd.withColumns({'score': F.lit('x'), 'lang': F.lit(None).cast('string')})
    assert toxicity.score(clash, model).columns.count('score') == 1 and toxicity.without_toxic(clash, model).columns == clash.columns


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).first()["score"] < 1e-9
    few = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, few)).first()["score"] > 0.99


def brute_viterbi(model, scores):
    from itertools import product

    def value(states):
        total = model.start[states[0]] + scores[0][states[0]]
        for i in range(1, len(states)):
            total += model.move[states[i - 1], states[i]] + scores[i][states[i]]
        return total

    return max(value(s) for s in product(range(transcripts.STATES), repeat=len(scores)))


def test_viterbi_in_segments():
    rng = np.random.default_rng(3)
    n = transcripts.STATES
    model = transcripts.Model(transcripts._log(rng.random(n)), transcripts._log(rng.random((n, n))), {})
    for length in (1, 2, 5):
        scores = np.log(rng.random((length, n)))
        states = transcripts.viterbi(model, scores)
        value = model.start[states[0]] + scores[0, states[0]] + sum(model.move[a, b] + scores[i + 1, b] for i, (a, b) in enumerate(zip(states[:-1], states[1:], strict=True)))
        assert np.isclose(value, brute_viterbi(model, scores))
    scores = np.log(rng.random((200, n)))
    whole = transcripts.viterbi(model, scores)
    cuts = [0, 1, 40, 90, 91, 200]
    parts = [scores[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    before, ends = transcripts.chain([transcripts.segment_matrix(model, p, i == 0) for i, p in enumerate(parts)])
    assert np.concatenate([transcripts.viterbi(model, p, b, e) for p, b, e in zip(parts, before, ends, strict=True)]).tolist() == whole.tolist()


def test_transcripts(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(60):
        for turn in range(6):
            role = "user" if turn % 2 == 0 else "assistant"
            text = " ".join(rng.choices(["alpha", "beta", "gamma"], k=6 if role == "user" else 60)) + ("?" if role == "user" else ".")
            if role == "assistant":
                text += "\n" + " ".join(rng.choices(["delta", "eps"], k=50)) + "."
            rows.append((conv, turn, role, text))
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", "alpha beta?" if t % 2 == 0 else "delta eps " * 30 + ".") for t in range(400)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(0), "line": F.lit("x"), "number": F.lit(9)})
    raw = transcripts.raw_transcripts(conv).drop("part", "line", "number").withColumns({"part": F.lit(0), "line": F.lit("x"), "number": F.lit(9)})
    model = transcripts.fit(raw)
    got = transcripts.parse(raw.drop("role").repartition(5), model).collect()
    want = {(c, t): (r, x) for c, t, r, x in rows}
    right = [(r.conv_id, r.turn) in want and want[(r.conv_id, r.turn)][0] == r.role for r in got]
    assert len(got) >= 0.97 * len(rows) and np.mean(right) > 0.97
    marked = [r for r in got if want[(r.conv_id, r.turn)] == (r.role, r.text)]
    assert len(marked) > 0.9 * len(rows)
    assert all(r.rendered == f"<|im_start|>{r.role}\n{r.text}<|im_end|>\n" for r in got)


def test_roles_of_held_out_conversations(spark, sf):
    """A model of half of the conversations names the roles of the other half's turns."""
    raw = transcripts.raw_transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    held = F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 1
    got = transcripts.parse(raw.where(held).drop("role"), transcripts.fit(raw.where(~held))).collect()
    want = {(r.conv_id, r.turn): r.role for r in raw.where(held).collect()}
    right = [want[(r.conv_id, r.turn)] == r.role for r in got if r.line_no == 0]
    assert len(right) >= 0.9 * len(want) and np.mean(right) >= 0.95


def test_odd_transcripts(spark):
    rows = [(None, 1, None), (None, None, "User: hi"), (1, 1, ""), (1, 1, ""), (2, 5, "Assistant: " + "w " * 20_000)]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    model = transcripts.fit(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    got = transcripts.parse(odd, model).collect()
    assert {r.conv_id for r in got} == {None, 1, 2}
    assert transcripts.parse(odd.limit(0), model).count() == 0
