"""Token ids in flat binary files that a trainer can map into memory.

A corpus is a folder with three files for each part: ``ids-NNNNN.bin``, unsigned little-endian
ids end to end, two bytes each where the vocabulary allows, else four; ``offsets-NNNNN.bin``, for
each document the 64-bit count of the corpus's ids before it, and one more for the end;
``docs-NNNNN.bin``, the 64-bit doc_ids.  Documents ascend by doc_id through the parts; rows without a
doc_id come first, their number is in the manifest.

Rows are encoded where they lie and their ids go to range partitions by doc_id, one part each.  The
base of a part is the sum of the counts before it: one number a part comes to the
driver, nothing of a document's size.  Files are written under another name and renamed, so a
repeated task leaves the same files.

Null text counts as empty; repeated doc_ids stand side by side in the order of their ids' bytes;
an empty table gives parts without documents.  Other columns aren't read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tokenloom.llm.bpe import default_vocabulary, encoder
from tokenloom.cluster import shared_folder
from tokenloom.llm.textual import blocks, string_buffers

MANIFEST = "part int, base long, documents long, nulls long, ids long, width int"


def row_encoder(vocabulary: str, end: int | None, bounds: list[int] | None = None):
    """A function from batches of ``doc_id, text`` to batches of ``doc_id, part, ids``, ids as bytes; part is the number of ``bounds`` below doc_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = encoder(vocabulary)
        edges = np.array(bounds or [], dtype=np.int64)
        tail = b"" if end is None else np.array([end], dtype=block.dtype).tobytes()
        for batch in batches:
            offsets, data = string_buffers(batch.column("text"))
            for low, high in blocks(offsets):
                ids, first = block.encode(offsets[low : high + 1], data[offsets[low] : offsets[high]])
                raw, width = ids.tobytes(), block.dtype.itemsize
                own = [raw[a * width : b * width] + tail for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                keys = batch.column("doc_id").slice(low, high - low)
                part = np.searchsorted(edges, keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)) if len(edges) else np.zeros(high - low, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([keys, pa.array(part.astype(np.int32)), pa.array(own, type=pa.binary())], names=["doc_id", "part", "ids"])

    return encode


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_rows(docs: DataFrame, vocabulary: str, end: int | None, bounds: list[int] | None = None) -> DataFrame:
    """``doc_id, part, ids`` of every row."""
    return ids_and_texts(docs).mapInArrow(row_encoder(vocabulary, end, bounds), "doc_id long, part int, ids binary")


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    attempt = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as out:
        out.write(data)
    fs.move(attempt, path)


def _write(uri: str, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(uri)
        part = TaskContext.get().partitionId()
        name = f"{root}/ids-{part:05d}.bin"
        attempt = f"{name}.{uuid.uuid4().hex}"
        lengths, keys, nulls = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
        with fs.open_output_stream(attempt) as out:
            for batch in batches:
                offsets, data = string_buffers(batch.column("ids"))
                out.write(data)
                lengths.append(np.diff(offsets) // width)
                nulls += batch.column("doc_id").null_count
                keys.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
        fs.move(attempt, name)
        n = np.concatenate(lengths)
        _put(fs, f"{root}/docs-{part:05d}.bin", np.concatenate(keys).astype("<i8").tobytes())
        _put(fs, f"{root}/lengths-{part:05d}.bin", n.astype("<u8").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "base": 0, "documents": len(n), "nulls": nulls, "ids": int(n.sum()), "width": width}], schema=_MANIFEST_ARROW)

    return write


_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("documents", pa.int64()), ("nulls", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())])


def _offsets(uri: str):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(uri)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/lengths-{row['part']:05d}.bin"
                with fs.open_input_stream(name) as f:
                    n = np.frombuffer(f.read(), dtype="<u8")
                _put(fs, f"{root}/offsets-{row['part']:05d}.bin", (np.concatenate([np.zeros(1, dtype="<u8"), np.cumsum(n, dtype="<u8")]) + np.uint64(row["base"])).astype("<u8").tobytes())
            yield batch

    return settle


def write_token_files(docs: DataFrame, uri: str | None = None, vocabulary: str | None = None, end: int | None = 2) -> tuple[str, DataFrame]:
    """Writes the corpus into folder ``uri``, below the shared folder unless given; gives it and the manifest."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    uri = uri or f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    fs, root = _folder(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    fs.create_dir(root)
    # a part for each task of the scan at least, so that parts don't grow with the corpus
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    cuts = [i / parts for i in range(1, parts)]
    bounds = sorted({int(x) for x in docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", cuts, 0.1 / parts)}) if cuts else []
    spread = encode_rows(docs, vocabulary, end, bounds).repartitionById(parts, F.col("part"))
    ordered = spread.sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids").select("doc_id", "ids")
    written = ordered.mapInArrow(_write(uri, encoder(vocabulary).dtype.itemsize), MANIFEST).toArrow().to_pandas().drop_duplicates("part").sort_values("part")
    written["base"] = written["ids"].cumsum() - written["ids"]
    manifest = spark.createDataFrame(written.reset_index(drop=True), MANIFEST).repartition(max(1, len(written)))
    manifest.mapInArrow(_offsets(uri), MANIFEST).count()
    return uri, manifest


def _map(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where it is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return np.frombuffer(f.read_buffer(), dtype=dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def _range(fs: pafs.FileSystem, path: str, dtype: str, low: int, high: int) -> np.ndarray:
    """Entries ``low`` to ``high`` of a file."""
    width = np.dtype(dtype).itemsize
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at((high - low) * width, low * width), dtype=dtype)


def read_token_files(uri: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(uri)
        for batch in batches:
            for row in batch.to_pylist():
                name, dtype = f"{root}/ids-{row['part']:05d}.bin", f"<u{row['width']}"
                mapped = _map(fs, name, dtype) if isinstance(fs, pafs.LocalFileSystem) else None
                offsets = _map(fs, f"{root}/offsets-{row['part']:05d}.bin", "<u8").astype(np.int64)
                keys = _map(fs, f"{root}/docs-{row['part']:05d}.bin", "<i8")
                for low in range(0, len(keys), 1024):
                    high = min(low + 1024, len(keys))
                    at = offsets[low : high + 1] - row["base"]
                    ids = mapped[at[0] : at[-1]] if mapped is not None else _range(fs, name, dtype, at[0], at[-1])
                    at = at - at[0]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    missing = np.arange(low, high) < row["nulls"]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[low:high], mask=missing), pa.array(offsets[low:high]), pa.array(np.diff(at)), pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
