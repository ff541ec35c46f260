"""Reads that mature in a stream of events (inventory row 347): per-file state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

MATURED = "session string, path string, at timestamp, matures timestamp"
#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Fixed value: the files of all sessions are dealt out to so many states, for a call and a timer of each file's own cost more than its events.
STATES = 1024


class _Holder(StatefulProcessor):
    """Of the files of a state: their reads that are held, and when each was touched; both are gone once they have matured.

    A read is let go when the watermark has passed its time, so an event that comes late, but not too late, is still taken in order.
    """

    def __init__(self, quiet_ms: int, hold_ms: int):
        self.quiet, self.hold = quiet_ms, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # an Arrow table: touches and reads of each file from its oldest held read on, in milliseconds
        self.touches = handle.getValueState("touches", StructType([StructField("table", BinaryType())]))

    def _held(self) -> list[pd.DataFrame]:
        return [pa.ipc.open_stream(bytes(self.touches.get()[0])).read_pandas()] if self.touches.exists() else []

    def _mature(self, touches: pd.DataFrame, until: int) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        """What has matured by ``until``, the touches still needed, and the next time to look."""
        rows = touches.sort_values(["session", "path", "at"], kind="stable").reset_index(drop=True)
        file = rows.groupby(["session", "path"], sort=False).ngroup().to_numpy()
        at, is_read = rows["at"].to_numpy(), rows["is_read"].to_numpy(dtype=bool)
        # a file's touch rests where the next one is another file's or comes after the quiet time; equal times wait for the last of them
        rests = np.append((file[1:] != file[:-1]) | (at[1:] - at[:-1] >= self.quiet), True)
        place = np.where(rests, np.arange(len(rows)), len(rows))
        quiet_at = at[np.minimum.accumulate(place[::-1])[::-1]] + self.quiet
        matures = np.minimum(quiet_at, at + self.hold)
        held = is_read & (matures > until)
        done = is_read & ~held
        out = pd.DataFrame({"session": rows["session"][done], "path": rows["path"][done], "at": pd.to_datetime(at[done], unit="ms", utc=True), "matures": pd.to_datetime(matures[done], unit="ms", utc=True)})
        oldest = np.full(file.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(oldest, file[held], at[held])
        # a touch by a read that has matured still counts for older ones that are held
        left = rows.assign(is_read=held)[at >= oldest[file]]
        return out, left, int(matures[held].min()) if held.any() else None

    def _settle(self, frames: list[pd.DataFrame], until: int) -> Iterator[pd.DataFrame]:
        if not frames:
            return
        out, left, due = self._mature(pd.concat(frames, ignore_index=True), until)
        if len(left):
            table, sink = pa.Table.from_pandas(left, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            self.touches.update((sink.getvalue().to_pybytes(),))
        else:
            self.touches.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)
        if len(out):
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [frame[["session", "path", "ms", "is_read"]].rename(columns={"ms": "at"}) for frame in rows]
        yield from self._settle([*self._held(), *new], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def maturing(events: DataFrame, quiet: str, hold: str, delay: str = "1 hour") -> DataFrame:
    """``session, path, at, matures`` of the reads of a stream ``session, path, ts, kind``: as ``operators.reads.matured_reads`` has them, once the watermark has passed.

    State is bounded by the watermark: a file's touches go with its last held read.  The session needs ``STORE``.
    """
    ms = lambda interval: int(pd.Timedelta(interval).total_seconds() * 1000)
    spark = events.sparkSession
    spark.conf.set(*STORE)
    own = events.where("path IS NOT NULL AND session IS NOT NULL").withWatermark("ts", delay)
    keyed = own.select(F.col("session").cast("string").alias("session"), "path", "ts", F.unix_millis("ts").alias("ms"), F.coalesce(F.col("kind") == "read", F.lit(False)).alias("is_read"))
    return keyed.withColumn("state", F.pmod(F.xxhash64("session", "path"), F.lit(STATES))).groupBy("state").transformWithStateInPandas(_Holder(ms(quiet), ms(hold)), MATURED, "append", "EventTime")
