"""Roles in raw transcripts by a hidden Markov model over line features, and canonical turns.

A line's hidden state is a role and whether the line begins a turn.  What is seen of it is the speaker marker it begins with,
its length, how it ends and how it begins; each of these is independent given the state.  Start, transition and emission
tables are counts of labelled transcripts, a few hundred numbers whatever their size.  Viterbi gives the
likeliest states, lines are joined into turns and rendered.

Transcripts are rows ``conv_id, turn, text`` with one or more lines each, in that order.  They are range partitioned
by it, so that one endless conversation is cut at partition borders like any other rows: each part of a conversation
is one segment.  A segment of a longer conversation is first reduced to a matrix, the best score from any state before it to any
state at its end; the matrices of a conversation, one a partition at most, are chained, and every
segment is then decoded between the states that the chain fixed.  The result is that of Viterbi over the whole.

Defined results: null text is one empty line; a null conv_id is a conversation of its own, a null turn comes first;
repeated rows stand side by side; an empty table gives no rows; a conversation always begins with the
beginning of a turn.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.scratch import Scratch

ROLES = ("system", "user", "assistant")
#: State 2 * r begins a turn of role r, state 2 * r + 1 continues it.
STATES = 2 * len(ROLES)
#: How transcripts mark speakers, by role.
MARKERS = {
    "system": r"^\s*(\[system\]|system\s*:|###\s*system\b:?|<\|system\|>|\*\*system:?\*\*:?)\s*",
    "user": r"^\s*(\[user\]|(user|human|question|q)\s*:|###\s*(user|human|instruction)\b:?|<\|user\|>|\*\*user:?\*\*:?)\s*",
    "assistant": r"^\s*(\[assistant\]|(assistant|ai|bot|answer|a)\s*:|###\s*(assistant|response)\b:?|<\|assistant\|>|\*\*assistant:?\*\*:?)\s*",
}
SPEAKER = r"^\s*[A-Z][\w .-]{0,24}:\s"
#: Turn numbers of a conversation whose neighbours are found together.
STRETCH = 4096
#: Number of values of each feature.
FEATURES = {"marker": 5, "size": 7, "ending": 4, "opening": 4}


def marker(line: Column) -> Column:
    """0 none, 1 to 3 the marker of a role, 4 some other name with a colon."""
    out = F.when(line.rlike(SPEAKER), 4).otherwise(0)
    for i, role in reversed(list(enumerate(ROLES))):
        out = F.when(line.rlike("(?i)" + MARKERS[role]), i + 1).otherwise(out)
    return out


def features(lines: DataFrame) -> DataFrame:
    """``lines`` with a column for each feature of ``line``."""
    line = F.col("line")
    words = F.when(F.trim(line) == "", 0).otherwise(F.size(F.split(F.trim(line), r"\s+")))
    size = F.when(words == 0, 0).when(words <= 3, 1).when(words <= 10, 2).when(words <= 25, 3).when(words <= 60, 4).when(words <= 150, 5).otherwise(6)
    end = F.when(line.rlike(r"\?\s*$"), 1).when(line.rlike(r"[.!]\s*$"), 2).when(line.rlike(r":\s*$"), 3).otherwise(0)
    begin = F.when(line.rlike(r"^\s*([-*] |\d+[.)] )"), 1).when(line.rlike(r"^\s*(```|    )"), 2).when(line.rlike(r"^\s*\p{Ll}"), 3).otherwise(0)
    return lines.withColumns({"marker": marker(line).cast("int"), "size": size.cast("int"), "ending": end.cast("int"), "opening": begin.cast("int")})


def lines_of(transcripts: DataFrame, *also: str) -> DataFrame:
    """``conv_id, turn, line_no, line`` and the columns in ``also``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *also, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


class Model:
    """Logarithms of the start, transition and emission tables."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: dict[str, np.ndarray]):
        self.start, self.move, self.emit = start, move, emit

    def scores(self, seen: dict[str, np.ndarray]) -> np.ndarray:
        """Of every line in every state."""
        return sum(self.emit[f][seen[f]] for f in FEATURES)


def _log(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    counts = counts + smooth
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def fit(transcripts: DataFrame) -> Model:
    """Counts of rows ``conv_id, turn, text, role``; rows with other roles are left out.  Texts stay in their tasks."""
    role = F.lower(F.col("role").cast("string"))
    known = transcripts.withColumn("role", role).where(F.col("role").isin(*ROLES))
    number = sum((F.when(F.col("role") == r, 2 * i).otherwise(0) for i, r in enumerate(ROLES)), F.lit(0))
    lines = features(lines_of(known, "role")).withColumn("state", number + (F.col("line_no") > 0).cast("int"))
    emit = {f: np.zeros((n, STATES)) for f, n in FEATURES.items()}
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES))).alias("p")
    for row in lines.select("state", pairs).groupBy("state", "p.feature", "p.value").count().collect():
        emit[row["feature"]][row["value"], row["state"]] = row["count"]
    # a turn is one row here: its role, the role after it, and its lines give all transitions.  Windows are over stretches
    # of a conversation's turns, the ends of stretches over one row each, so that an endless conversation isn't one task
    n = F.size(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))
    stretch = F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / STRETCH)
    turns = known.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), "role", n.alias("n"), stretch.alias("stretch"))
    order = F.struct("turn", "role", "n")
    edges = turns.groupBy("conv_id", "stretch").agg(F.min(order)["role"].alias("opens"))
    edges = edges.select("conv_id", "stretch", F.lead("opens").over(Window.partitionBy("conv_id").orderBy("stretch")).alias("next"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("stretch")) == 1).alias("begins"))
    own = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "n")
    turns = turns.select("*", F.lead("role").over(own).alias("within"), (F.row_number().over(own) == 1).alias("leads")).withColumnsRenamed({"conv_id": "c", "stretch": "s"})
    turns = turns.join(edges, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("s") == F.col("stretch")))
    turns = turns.select("role", F.coalesce("within", "next").alias("after"), (F.col("leads") & F.col("begins")).alias("first"), "n")
    start, move = np.zeros(STATES), np.zeros((STATES, STATES))
    for row in turns.groupBy("role", "after", "first").agg(F.count("*").alias("turns"), F.sum("n").alias("lines"), F.count_if(F.col("n") == 1).alias("single")).collect():
        own = 2 * ROLES.index(row["role"])
        if row["first"]:
            start[own] += row["turns"]
        move[own, own + 1] += row["turns"] - row["single"]
        move[own + 1, own + 1] += row["lines"] - 2 * row["turns"] + row["single"]
        if row["after"] is not None:
            to = 2 * ROLES.index(row["after"])
            move[own, to] += row["single"]
            move[own + 1, to] += row["turns"] - row["single"]
    log_move = _log(move)
    for r in range(len(ROLES)):  # only a state of the same role can be continued
        for other in range(STATES):
            if other // 2 != r:
                log_move[other, 2 * r + 1] = -np.inf
    log_start = _log(start)
    log_start[1::2] = -np.inf
    return Model(log_start, log_move, {f: np.log((c + 0.5) / (c + 0.5).sum(axis=0)) for f, c in emit.items()})


def segment_matrix(model: Model, scores: np.ndarray, first: bool) -> np.ndarray:
    """Best score from each state before a segment (row 0 stands for the start) to each state at its end."""
    best = model.start[None, :] + scores[0] if first else model.move + scores[0]
    for s in scores[1:]:
        best = (best[:, :, None] + model.move[None, :, :]).max(axis=1) + s
    return best


def viterbi(model: Model, scores: np.ndarray, before: int | None = None, end: int | None = None) -> np.ndarray:
    """The likeliest states of a segment; ``before`` and ``end`` fix the state before it and its last one."""
    best = (model.start if before is None else model.move[before]) + scores[0]
    back = np.zeros((len(scores), STATES), dtype=np.int8)
    for i in range(1, len(scores)):
        through = best[:, None] + model.move
        back[i] = through.argmax(axis=0)
        best = through.max(axis=0) + scores[i]
    out = np.empty(len(scores), dtype=np.int8)
    out[-1] = best.argmax() if end is None else end
    for i in range(len(scores) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def chain(matrices: list[np.ndarray]) -> tuple[list[int | None], list[int]]:
    """For the segments of a conversation the state before each (None for the first) and its last one."""
    best = [matrices[0][0]]
    for m in matrices[1:]:
        best.append((best[-1][:, None] + m).max(axis=0))
    ends = [int(best[-1].argmax())]
    for k in range(len(matrices) - 1, 0, -1):
        ends.insert(0, int((best[k - 1] + matrices[k][:, ends[0]]).argmax()))
    return [None, *ends[:-1]], ends


def runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Neighbouring rows that agree in ``by``, together although batches cut them."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(c)[i].as_py() for c in by)

    for batch in batches:
        if not len(batch):
            continue
        changed = np.zeros(len(batch), dtype=bool)
        for c in by:
            column = batch.column(c)
            values = column.fill_null(0).to_numpy(zero_copy_only=False)
            empty = column.is_null().to_numpy(zero_copy_only=False)
            changed[1:] |= (values[1:] != values[:-1]) | (empty[1:] != empty[:-1])
        edges = [0, *np.flatnonzero(changed).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            piece = batch.slice(a, b - a)
            if held and key(held[-1], 0) != key(piece, 0):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def _seen(rows: pa.Table) -> dict[str, np.ndarray]:
    return {f: rows.column(f).to_numpy() for f in FEATURES}


def _matrices(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ("conv_id", "part")):
            part = rows.column("part")[0].as_py()
            m = segment_matrix(model, model.scores(_seen(rows)), part == rows.column("low")[0].as_py())
            yield pa.RecordBatch.from_pydict({"conv_id": [rows.column("conv_id")[0].as_py()], "part": [part], "matrix": [m.ravel().tolist()]}, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("matrix", pa.list_(pa.float64()))]))

    return run


def _chains(key, pdf):
    import pandas as pd

    pdf = pdf.sort_values("part")
    before, ends = chain([np.array(m).reshape(-1, STATES) for m in pdf["matrix"]])
    return pd.DataFrame({"conv_id": pdf["conv_id"], "part": pdf["part"], "before": pd.array(before, dtype="Int32"), "end": ends})


def _decode(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ("conv_id", "part")):
            states = viterbi(model, model.scores(_seen(rows)), rows.column("before")[0].as_py(), rows.column("end")[0].as_py())
            begins = states % 2 == 0
            number = np.cumsum(begins)  # 0: the turn began in an earlier segment
            out = rows.select(["conv_id", "part", "turn", "line_no", "line", "marker"])
            out = out.append_column("role", pa.array([ROLES[s // 2] for s in states])).append_column("begins", pa.array(begins)).append_column("number", pa.array(number.astype(np.int64)))
            yield from out.to_batches()

    return run


LINES = "conv_id long, part int, turn long, line_no int, line string, marker int, role string, begins boolean, number long"


def decode_lines(transcripts: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """Every line with its role and turn: ``conv_id, part, turn, line_no, line, marker, role, begins, number, home``.

    ``part, number`` count turns; ``home`` is the part where the line's turn began.
    """
    ordered = features(lines_of(transcripts)).repartitionByRange(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "line_no", "line")
    lines = scratch.save(ordered.withColumn("part", F.spark_partition_id()), "lines")
    spans = lines.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    wide = spans.where("low != high")
    order = ["conv_id", "part", F.asc_nulls_first("turn"), "line_no", "line"]
    own = lines.join(wide, lines["conv_id"].eqNullSafe(wide["conv_id"])).select(lines["*"], "low")
    matrices = own.repartition("conv_id", "part").sortWithinPartitions(*order).mapInArrow(_matrices(model), "conv_id long, part int, matrix array<double>")
    fixed = matrices.groupBy("conv_id").applyInPandas(_chains, "conv_id long, part int, before int, end int")
    fixed = scratch.save(fixed, "fixed").withColumnsRenamed({"conv_id": "c", "part": "p"})
    joined = lines.join(fixed, lines["conv_id"].eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")
    decoded = scratch.save(joined.repartition("conv_id", "part").sortWithinPartitions(*order).mapInArrow(_decode(model), LINES), "decoded")
    # a segment without a beginning belongs to the last one before it that has: one row a segment
    segments = decoded.groupBy("conv_id", "part").agg(F.max("number").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    had = F.last(F.when(F.col("last") > 0, F.struct("part", "last")), ignorenulls=True).over(earlier)
    carry = segments.join(wide, segments["conv_id"].eqNullSafe(wide["conv_id"]), "left_semi").select("conv_id", "part", had.alias("had")).withColumnsRenamed({"conv_id": "c", "part": "p"})
    out = decoded.join(carry, decoded["conv_id"].eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    inherited = (F.col("number") == 0) & F.col("had").isNotNull()
    return out.select(
        "conv_id", "turn", "line_no", "line", "marker", "role", "begins", F.when(inherited, F.col("had.part")).otherwise(F.col("part")).alias("home"), F.when(inherited, F.col("had.last")).otherwise(F.col("number")).alias("number")
    )


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """``conv_id, turn, line_no, role, text, rendered``: a row for each recovered turn, named by where it begins."""
    lines = decode_lines(transcripts, model, Scratch(transcripts.sparkSession, "transcripts"))
    bare = F.col("line")
    for role in ROLES:
        bare = F.when(F.col("marker") == ROLES.index(role) + 1, F.regexp_replace("line", "(?i)" + MARKERS[role], "")).otherwise(bare)
    place = F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("o"), "line_no", F.when(F.col("begins"), bare).otherwise(F.col("line")).alias("line"), "turn")
    turns = lines.groupBy("conv_id", "home", "number", "role").agg(F.array_sort(F.collect_list(place)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    out = turns.select("conv_id", F.col("lines")[0]["turn"].alias("turn"), F.col("lines")[0]["line_no"].alias("line_no"), "role", F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as they are found in the wild: a style of marker each, every tenth marker missing, roles gone."""
    role = F.lower(F.coalesce(F.col("role").cast("string"), F.lit("")))
    named = F.initcap(role)
    qa = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise(named)
    styles = [F.concat(named, F.lit(": ")), F.concat(F.when(role == "user", "Human").otherwise(named), F.lit(": ")), F.concat(F.lit("### "), named, F.lit("\n")), F.concat(F.lit("<|"), role, F.lit("|>\n")), F.concat(qa, F.lit(": ")), F.concat(F.lit("["), role, F.lit("] "))]
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(styles)))
    mark = styles[-1]
    for i, s in enumerate(styles[:-1]):
        mark = F.when(style == i, s).otherwise(mark)
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) == 0
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.withColumn("text", F.when(lost | (role == ""), text).otherwise(F.concat(mark, text)))
