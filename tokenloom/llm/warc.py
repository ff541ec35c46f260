"""WARC archives: writing them as one gzip stream, normalising them to a member a record, reading by index.

``write_archives`` makes one file a partition, the whole file one gzip stream, as crawlers sometimes leave them: a
reader must inflate it from the start to reach any record.  ``normalise`` inflates each file once, as
a stream, rewrites every record as a gzip member of its own and writes a sidecar index with a line
a record: offset, length, type, page.  ``read_records`` then goes straight to the members.

A page whose payload of at least ``REVISIT_BYTES`` bytes equals that of a page with a smaller id becomes a revisit
record without the payload, with its digest and the id of that page.

Null html is an empty payload.  A page without an id is never the one referred to; it becomes a revisit where its
payload has an owner.  Rows that repeat the smallest id are responses.  An empty table gives no
files and no rows.  A null url becomes ``urn:x-missing``; only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tokenloom.cluster import shared_folder

REVISIT_BYTES = 100
#: Of the records, which have no date of their own.
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
#: Rows of an archive that are given together.
ROWS = 1000
FILE = "uri string, records long, bytes long"
_FILE_ARROW = pa.schema([("uri", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_CONTENT_LENGTH = re.compile(rb"\r\ncontent-length:\s*(\d+)", re.IGNORECASE)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 record with an HTTP head; without its payload if it refers to another page."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    target = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else "urn:x-missing"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """What ``record_bytes`` put in: headers in lower case, payload bytes and the declared payload length."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    fields["payload"] = payload
    fields["payload_bytes"] = int(_CONTENT_LENGTH.search(http)[1])
    return fields


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The content of a gzip file as a stream of pieces, whatever its members."""
    stream = zlib.decompressobj(31)
    while chunk := read(CHUNK):
        while chunk:
            if stream.eof:
                stream = zlib.decompressobj(31)
            yield stream.decompress(chunk)
            chunk = stream.unused_data
    yield stream.flush()


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of inflated content, holding no more than one record and one piece."""
    buffer, need = bytearray(), None
    for piece in pieces:
        buffer += piece
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(_CONTENT_LENGTH.search(bytes(buffer[:end]))[1]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError(f"{len(buffer)} bytes of a cut-off record at the end")


def with_owners(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``.

    Owners are found on ids and digests alone; payloads are joined to them by page and digest, so that a payload that many
    pages have doesn't bring those to one task.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    plain = plain.withColumn("digest", F.sha2("payload", 256))
    large = plain.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    owners = large.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 AND owner IS NOT NULL").select("digest", "owner")
    refers = large.join(owners, "digest").where(~F.col("page_id").eqNullSafe(F.col("owner"))).distinct().withColumnsRenamed({"page_id": "page", "digest": "same", "owner": "refers_to"})
    return plain.join(refers, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("same")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(pages: DataFrame, uri: str | None = None, level: int = 6) -> tuple[str, DataFrame]:
    """Writes the pages into folder ``uri``, below the shared folder unless given; gives it and its files."""
    uri = uri or f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    fs, root = _fs(uri)
    fs.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(uri)
        name = f"{root}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        attempt, records = f"{name}.{uuid.uuid4().hex}", 0
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        size = 0
        with fs.open_output_stream(attempt) as out:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    size += out.write(pack.compress(record_bytes(*(x.as_py() for x in row))))
                    records += 1
            size += out.write(pack.flush())
        if not records:
            fs.delete_file(attempt)
            return
        fs.move(attempt, name)
        yield pa.RecordBatch.from_pylist([{"uri": name.rsplit("/", 1)[1], "records": records, "bytes": size}], schema=_FILE_ARROW)

    files = with_owners(pages).mapInArrow(write, FILE).toArrow().to_pandas().drop_duplicates("uri")
    return uri, pages.sparkSession.createDataFrame(files, FILE).repartition(max(1, len(files)))


def rewrite(source: BinaryIO, target: BinaryIO, level: int = 6) -> Iterator[dict]:
    """Copies a WARC file to one member a record; gives the index line of each."""
    offset = 0
    for record in split_records(inflate(source.read)):
        fields = parse_record(record)
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = pack.compress(record) + pack.flush()
        target.write(member)
        yield {"offset": offset, "length": len(member), "type": fields["warc-type"], "page": fields.get("x-page-id")}
        offset += len(member)


def normalise(uri: str, files: DataFrame, keep_source: bool = False) -> DataFrame:
    """Each file as ``.members.warc.gz`` with ``.index`` beside it; gives the new files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(uri)
        for batch in batches:
            for name in batch.column("uri").to_pylist():
                new = name.removesuffix(".warc.gz") + ".members.warc.gz"
                attempt, records = f"{root}/{new}.{uuid.uuid4().hex}", 0
                if fs.get_file_info(f"{root}/{new}").type == pafs.FileType.NotFound:
                    with fs.open_input_stream(f"{root}/{name}", compression=None) as source, fs.open_output_stream(attempt, compression=None) as target, fs.open_output_stream(f"{attempt}.index") as index:
                        for line in rewrite(source, target):
                            index.write(json.dumps(line).encode() + b"\n")
                    fs.move(f"{attempt}.index", f"{root}/{new}.index")
                    fs.move(attempt, f"{root}/{new}")
                    if not keep_source:  # a repeated task finds the new file, which is complete once it has its name
                        fs.delete_file(f"{root}/{name}")
                info = fs.get_file_info(f"{root}/{new}")
                with fs.open_input_stream(f"{root}/{new}.index") as index:
                    records = index.read().count(b"\n")
                yield pa.RecordBatch.from_pylist([{"uri": new, "records": records, "bytes": info.size}], schema=_FILE_ARROW)

    made = files.mapInArrow(run, FILE).toArrow().to_pandas().drop_duplicates("uri")
    return files.sparkSession.createDataFrame(made, FILE).repartition(max(1, len(made)))


def read_records(uri: str, files: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every member by the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(uri)
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for name in batch.column("uri").to_pylist():
                rows: list[dict] = []
                schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
                with fs.open_input_file(f"{root}/{name}") as data, fs.open_input_stream(f"{root}/{name}.index") as index:
                    for line in index.read().splitlines():
                        at = json.loads(line)
                        data.seek(at["offset"])
                        got = parse_record(zlib.decompress(data.read(at["length"]), 31))
                        whole = got["warc-type"] == "response"
                        if whole and len(got["payload"]) != got["payload_bytes"]:
                            raise ValueError(f"{name}: a payload of {len(got['payload'])} bytes, {got['payload_bytes']} declared")
                        digest = hashlib.sha256(got["payload"]).hexdigest() if whole else got["warc-payload-digest"].removeprefix("sha256:")
                        rows.append({"page_id": number(got.get("x-page-id")), "payload_bytes": got["payload_bytes"], "payload_digest": digest, "record_type": got["warc-type"], "refers_to": number(got.get("x-refers-to-page-id"))})
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
