"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of a row for its hash and a row for the hash of its first bytes, so
that an unseen form of a known stem still has half of one.  Filters of widths 1, 2 and 3 run over the embeddings,
each keeps its maximum over the text, and a linear layer of those maxima gives the score.  Only text enters it.

Training takes a bounded sample of the labelled rows: ``SAMPLE`` of either label at most, those with the smallest hash
of their id.  A quarter of it sets the scale of the score, where 0.7 stands for the best cut over all languages, and a
cut for each language with enough labelled rows.  The sample and the model are of a fixed size.

Defined results: a null or empty text is scored like any other (by the model's bias); rows that repeat an id enter training once, with their least text; repeated rows
get the same score but for the rounding of 32-bit sums; labels of an id that disagree count as toxic; without labels of both kinds every score is
the share of toxic labels (0 without any); an empty table gives no rows; a null or rare language takes the
overall cut.  Columns of ``docs`` other than doc_id, text and lang are passed through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tokenloom.llm.textual import MARKS, blocks, string_buffers, words_of

#: Labelled rows of either label that training sees at most, whole texts.
SAMPLE = 2500
BUCKETS_BITS, DIMENSIONS, FILTERS, WIDTHS = 17, 8, 8, (1, 2, 3)
EPOCHS, LEAST_STEPS, BATCH, RATE, HEAD_BYTES = 6, 600, 32, 0.02, 4
#: Bytes of text scored at once: a word takes some 300 bytes of products meanwhile.
BLOCK_BYTES = 1 << 18
#: Words of one text that are scored at once.
LONG = 1 << 16
#: The score that stands for the overall cut.
CUT = 0.7
#: Labelled rows of a language, and of either label in it, from which it gets a cut of its own.
LANGUAGE_ROWS, LANGUAGE_LABEL = 40, 8
#: Empty words after each text, so that every filter has a window in an empty one too.
_PAD = max(WIDTHS)


@dataclass
class Model:
    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    constant: float = 0.0
    #: score = sigmoid(scale * z + shift)
    scale: float = 1.0
    shift: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)

    def maxima(self, rows: np.ndarray, first: np.ndarray, ends: bool = True) -> np.ndarray:
        """The filters' maxima for texts whose words' table rows are ``rows[first[i]:first[i + 1]]``; ``ends`` takes in windows that end in the padding."""
        n = len(first) - 1
        counts = np.diff(first)
        at = np.arange(len(rows)) + np.repeat(np.arange(n) * _PAD, counts)
        x = np.zeros((len(rows) + n * _PAD + 1, DIMENSIONS), dtype=np.float32)
        x[at] = self.table[rows[:, 0]] + self.table[rows[:, 1]]
        begin = first[:-1] + np.arange(n) * _PAD
        # all products at once, a filter a row: sums of shifted rows are the convolutions
        every = np.concatenate([self.filters[w][o] for w in WIDTHS for o in range(w)], axis=1).T @ np.ascontiguousarray(x.T)
        out, row = [], 0
        for w in WIDTHS:
            z = every[row : row + FILTERS]
            for o in range(1, w):
                z[:, : z.shape[1] - o] += every[row + o * FILTERS : row + (o + 1) * FILTERS, o:]
            row += w * FILTERS
            spans = np.stack([begin, begin + counts + (_PAD - w + 1 if ends else 1 - w)], axis=1).ravel()  # windows that end in the text's own padding
            out.append(np.maximum.reduceat(z, spans, axis=1)[:, ::2])
        return np.concatenate(out).T

    def _longest(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``maxima`` of a block, in slices where it is one long text."""
        if len(first) > 2 or len(rows) <= LONG:
            return self.maxima(rows, first)
        # slices overlap by the words of a window; windows into the padding count in the last slice alone
        parts = []
        for low in range(0, len(rows), LONG):
            part = rows[low : low + LONG + _PAD - 1]
            parts.append(self.maxima(part, np.array([0, len(part)]), low + LONG >= len(rows)))
        return np.max(parts, axis=0)

    def raw(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores before scaling."""
        return np.tanh((self._longest(rows, first) + self.bias).astype(np.float64)) @ self.weights.astype(np.float64) + self.constant

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def word_rows(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two table rows of every word of a block of texts, and where each text's words begin."""
    words = words_of(offsets, data, MARKS, HEAD_BYTES)
    shift = np.uint64(64 - BUCKETS_BITS)
    return np.stack([(words.hashes >> shift).astype(np.int64), ((words.heads ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x2545F4914F6CDD1D) >> shift).astype(np.int64)], axis=1), words.first


def _rows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of any number of texts, a block at a time."""
    offsets, data = string_buffers(texts)
    parts = [word_rows(offsets[low : high + 1], data[offsets[low] : offsets[high]]) for low, high in blocks(offsets)]
    counts = np.concatenate([np.zeros(0, dtype=np.int64), *(np.diff(first) for _, first in parts)])
    return np.concatenate([np.zeros((0, 2), np.int32), *(rows.astype(np.int32) for rows, _ in parts)]), np.concatenate([[0], np.cumsum(counts)])


def _by_words(texts: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """The texts in groups of about ``LONG`` words, one text at least."""
    ends = np.cumsum(first[texts + 1] - first[texts])
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + LONG)))
        yield texts[low:high]
        low = high


def _backward(rows, first, texts, labels, weight, table, params, grads, touched, pulls) -> None:
    """Adds the gradients of some texts; the table's go to ``touched`` and ``pulls``."""
    counts = first[texts + 1] - first[texts]
    n = len(texts)
    begin = np.concatenate([[0], np.cumsum(counts + _PAD)])
    at = np.arange(counts.sum()) + np.repeat(begin[:-1] - (np.cumsum(counts) - counts), counts)
    source = np.arange(counts.sum()) + np.repeat(first[texts] - (np.cumsum(counts) - counts), counts)
    inside = np.full(begin[-1], -1, dtype=np.int64)  # the word of each row of x, -1 in the padding
    inside[at] = source
    x = np.zeros((begin[-1], DIMENSIONS), np.float32)
    x[at] = table[rows[source, 0]] + table[rows[source, 1]]
    tops, places = [], []
    for w in WIDTHS:
        size = len(x) - w + 1
        z = x[:size] @ params[f"filter{w}"][0]
        for o in range(1, w):
            z += x[o : size + o] @ params[f"filter{w}"][o]
        spans = np.stack([begin[:-1], begin[1:] - w + 1], axis=1).ravel()
        z = np.concatenate([z, np.full((1, FILTERS), -np.inf, np.float32)])  # a span may end where z does
        top = np.maximum.reduceat(z, spans, axis=0)[::2]
        text = np.repeat(np.arange(n), counts + _PAD)
        row, column = np.nonzero(z[:size] == top[text[:size]])
        fits = row <= begin[text[row] + 1] - w  # windows that run into the next text aren't this one's
        row, column = row[fits][::-1], column[fits][::-1]
        place = np.zeros((n, FILTERS), dtype=np.int64)
        place[text[row], column] = row  # the first of equal ones
        tops.append(top)
        places.append(place)
    kept = np.tanh(np.concatenate(tops, axis=1) + params["bias"])
    out = kept @ params["weights"] + params["constant"][0]
    own = labels[texts]
    error = np.where(own > 0, weight[1], weight[0]) * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - own)
    grads["constant"] += error.sum()
    grads["weights"] += error @ kept
    back = (error[:, None] * params["weights"] * (1 - kept * kept)).astype(np.float32)
    grads["bias"] += back.sum(axis=0)
    for j, w in enumerate(WIDTHS):
        own_back = back[:, j * FILTERS : (j + 1) * FILTERS]
        for o in range(w):
            seat = places[j] + o
            grads[f"filter{w}"][o] += np.einsum("nfd,nf->df", x[seat], own_back)
            word = inside[seat]
            real = word >= 0
            pull = own_back[..., None] * params[f"filter{w}"][o].T
            touched.append(rows[word[real]].ravel())
            pulls.append(np.repeat(pull[real], 2, axis=0))


def _fit_filters(rows: np.ndarray, first: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> Model:
    """Adam on the logistic loss; a step touches the filters and the embeddings where a filter had its maximum."""
    size = 1 << BUCKETS_BITS
    n = len(labels)
    texts_with = np.zeros(size, dtype=np.int64)
    for i in range(n):
        texts_with[np.unique(rows[first[i] : first[i + 1]])] += 1
    seen = texts_with > 1  # a word of one training text could only be learnt by heart; it weighs nothing, like one never seen
    table = (rng.standard_normal((size, DIMENSIONS)) * 0.05).astype(np.float32) * seen[:, None]
    params = {"bias": np.zeros(FILTERS * len(WIDTHS), np.float32), "weights": (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32), "constant": np.zeros(1, np.float32)}
    for w in WIDTHS:
        params[f"filter{w}"] = (rng.standard_normal((w, DIMENSIONS, FILTERS)) / np.sqrt(w * DIMENSIONS)).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    squares = np.zeros(size, dtype=np.float32)  # of the table, one a row
    step = 0
    weight = [n / (2 * (n - labels.sum())), n / (2 * labels.sum())]  # the labels count alike
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // n))):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            step += 1
            grads = {k: np.zeros_like(v) for k, v in params.items()}
            touched, pulls = [], []
            for own in _by_words(order[low : low + BATCH], first):
                _backward(rows, first, own, labels, weight, table, params, grads, touched, pulls)
            for k, g in grads.items():
                g = g / BATCH + 1e-5 * params[k]
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= RATE * 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if touched:
                at, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                g = np.zeros((len(at), DIMENSIONS), np.float32)
                np.add.at(g, inverse, np.concatenate(pulls) / BATCH)
                squares[at] += (g * g).mean(axis=1)
                table[at] -= 0.1 * seen[at, None] * g / (np.sqrt(squares[at])[:, None] + 1e-6)
    return Model(table, {w: params[f"filter{w}"] for w in WIDTHS}, params["bias"], params["weights"], float(params["constant"][0]))


def best_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the most right answers at equal weight of the labels; the middle of the gap or gaps that tie."""
    order = np.argsort(z, kind="stable")
    z, labels = z[order], labels[order]
    toxic, clean = labels.sum(), (1 - labels).sum()
    right = (toxic - np.concatenate([[0], np.cumsum(labels)])) / max(toxic, 1) + np.concatenate([[0], np.cumsum(1 - labels)]) / max(clean, 1)
    right[1:-1][z[1:] == z[:-1]] = -1
    tied = np.flatnonzero(right >= right.max() - 1e-9)
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    return float((edges[tied[0]] + edges[tied[-1] + 1]) / 2)


def train(texts: list[str | None] | pa.Array, labels: np.ndarray, languages: list[str | None], seed: int = 7) -> Model:
    """A model of labelled texts; every fourth calibrates it."""
    labels = np.asarray(labels, dtype=np.float32)
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    if len(labels) < 8 or not 0 < share < 1:
        z = np.zeros((1 << BUCKETS_BITS, DIMENSIONS), np.float32)
        shift = -30.0 if share == 0 else float(np.log(share / max(1 - share, 1e-9)))
        return Model(z, {w: np.zeros((w, DIMENSIONS, FILTERS), np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0, 0.0, max(shift, -30.0))
    rows, first = _rows_of(pa.array(texts, type=pa.string()) if isinstance(texts, list) else texts)
    del texts
    fold = np.zeros(len(labels), dtype=bool)
    for y in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == y))
        fold[own[: len(own) // 4]] = True
    fit = np.flatnonzero(~fold)
    cut_rows = lambda which: (np.concatenate([rows[first[i] : first[i + 1]] for i in which]), np.concatenate([[0], np.cumsum([first[i + 1] - first[i] for i in which])]))
    model = _fit_filters(*cut_rows(fit), labels[fit], rng)
    own = np.flatnonzero(fold) if fold.any() and 0 < labels[fold].mean() < 1 else np.arange(len(labels))
    z = np.concatenate([model.raw(*cut_rows(own[i : i + 64])) for i in range(0, len(own), 64)])
    cut = best_cut(z, labels[own])
    spread = max(float(np.median(z[labels[own] == 1]) - np.median(z[labels[own] == 0])), 1e-3)
    model.scale = 6 / spread
    model.shift = float(np.log(CUT / (1 - CUT))) - model.scale * cut
    score = model.score(z)
    tongue = np.array([x or "" for x in languages])[own]
    for x in sorted(set(tongue) - {""}):
        same = tongue == x
        if same.sum() >= LANGUAGE_ROWS and min(labels[own][same].sum(), (1 - labels[own][same]).sum()) >= LANGUAGE_LABEL:
            model.cuts[x] = best_cut(score[same], labels[own][same])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, where: Column | None = None, size: int = SAMPLE) -> DataFrame:
    """``text, lang, toxic`` of at most ``size`` labelled documents of either label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if where is not None:
        known = known.where(where)
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # 2 * size ids at most, so they are sent to the documents; one row an id, so that a repeated row weighs once
    found = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang", "toxic")).alias("row"))
    return found.orderBy("doc_id").select("row.text", "row.lang", "row.toxic")


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, size: int = SAMPLE) -> Model:
    sample = labelled_sample(docs, labels, where, size).toArrow()
    return train(sample["text"].combine_chunks(), sample["toxic"].to_numpy(), sample["lang"].to_pylist())


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    offsets, data = string_buffers(texts.cast(pa.string()))
    out = [model.score(model.raw(*word_rows(offsets[low : high + 1], data[offsets[low] : offsets[high]]))) for low, high in blocks(offsets, BLOCK_BYTES)]
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` of ``text`` after them, in place of one of that name."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_scores(m, batch.column("text")), type=pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def cut_of(model: Model, lang: Column) -> Column:
    """The cut of a row's language."""
    cuts = F.lit(CUT)
    for x, cut in model.cuts.items():
        cuts = F.when(lang == x, F.lit(cut)).otherwise(cuts)
    return cuts


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below the cut of their language; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            cuts = np.array([m.cuts.get(x, CUT) for x in batch.column("lang").to_pylist()], dtype=np.float64)
            yield batch.filter(pa.array(_scores(m, batch.column("text")) < cuts, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
