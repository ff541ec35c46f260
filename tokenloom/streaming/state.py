"""Keyed state that no window expresses (inventory rows 28, 328, 331, 379, 461).

Each function is plain Python over one key's rows and state; the frames around them run
them per key, in batches or streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "key string, id long, admitted boolean, wait double"
FRAMES = "conn long, n long, event string, data string"


def bucket_step(tokens: float, then: float | None, now: float, need: float, per_minute: float) -> tuple[float, bool, float]:
    """Rows 328 and 379: refills up to the rate, then takes ``need`` or says how long to wait."""
    if then is not None:
        tokens = min(per_minute, tokens + max(0.0, now - then) * per_minute / 60)
    if tokens >= need:
        return tokens - need, True, 0.0
    return tokens, False, (need - tokens) * 60 / per_minute


def rate_limited(requests: DataFrame, per_minute: float) -> DataFrame:
    """Row 379: ``key, id, at (seconds), need`` -> which requests a token bucket of each key admits, in order of time.

    The state of a key is its level and the time of its last request; a micro-batch's rows of a key
    are taken in order of (at, id).
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, then = state.get if state.exists else (per_minute, None)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for i, now, need in zip(rows["id"], rows["at"], rows["need"], strict=True):
            tokens, admitted, wait = bucket_step(tokens, then, now, need, per_minute)
            then = now if then is None else max(then, now)
            out.append((key[0], i, admitted, wait))
        state.update((float(tokens), then))
        yield pd.DataFrame(out, columns=["key", "id", "admitted", "wait"])

    return requests.groupBy("key").applyInPandasWithState(run, ADMITTED, "tokens double, then double", "append", GroupStateTimeout.NoTimeout)


def split_frames(buffer: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Row 461: the whole events at the front of a byte buffer as (event, data), and what is left of it.

    Data lines of an event are joined by line ends; comments and other fields are skipped.
    """
    out = []
    buffer = buffer.replace(b"\r\n", b"\n")
    while (end := buffer.find(b"\n\n")) >= 0:
        block, buffer = buffer[:end].decode("utf-8", "replace"), buffer[end + 2 :]
        event, data = "message", []
        for line in block.split("\n"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "event":
                event = value
            elif name == "data":
                data.append(value)
        if data:
            out.append((event, "\n".join(data)))
    return out, buffer


def framed(chunks: DataFrame) -> DataFrame:
    """Row 28: ``conn, seq, bytes`` cut anywhere, even inside a character -> whole server-sent events in order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, n = state.get if state.exists else (b"", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        events, rest = split_frames(bytes(buffer) + b"".join(bytes(x) for x in rows["bytes"]))
        state.update((rest, n + len(events)))
        yield pd.DataFrame([(key[0], n + i, e, d) for i, (e, d) in enumerate(events)], columns=["conn", "n", "event", "data"])

    return chunks.groupBy("conn").applyInPandasWithState(run, FRAMES, "rest binary, n long", "append", GroupStateTimeout.NoTimeout)


def aimd(level: int, verdicts: list[str]) -> int:
    """Row 331: one step down on TOO_LITTLE with a pause of five, one up after three TOO_MUCH in a row; 1 to 4."""
    pause = row = 0
    for v in verdicts:
        pause = max(0, pause - 1)
        if v == "TOO_LITTLE":
            level, pause, row = max(1, level - 1), 5, 0
        elif v == "TOO_MUCH":
            row += 1
            if row >= 3 and not pause:
                level, row = min(4, level + 1), 0
        else:
            row = 0
    return level
