"""A Bloom filter of ids, made by Spark and of one size whatever their number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**26 bits, 8 MB: what is broadcast and, as one row for each 64 bits at most, what comes to the driver.
BITS = 26
PROBES = 3


def _places(halves: np.ndarray) -> list[np.ndarray]:
    """Bit places of ids given as pairs of 64-bit values."""
    shift = np.uint64(64 - BITS)
    return [(halves[:, 0] + np.uint64(i) * (halves[:, 1] | np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15) >> shift for i in range(PROBES)]


def _split(batches):
    import pyarrow as pa

    for batch in batches:
        ids = np.frombuffer(b"".join(batch.column("cid").to_pylist()), dtype="<u8").reshape(-1, 2)
        for place in _places(ids):
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["slot", "bit"])


def bloom(ids: DataFrame) -> np.ndarray:
    """The filter of the 16-byte ids in column ``cid``: misses none, passes others the more the fuller it is."""
    slots = ids.mapInArrow(_split, "slot int, bit long").groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    table[slots["slot"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    return table


def maybe_in(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the ids, pairs of 64-bit values, may be in the filter."""
    found = np.ones(len(ids), dtype=bool)
    for place in _places(ids):
        found &= (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found
