"""WARC archives: written, resolved so that equal payloads are stored once, written anew and read."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import groupby, islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.shared import blocks, materialize, new_folder, ready, spread

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n"
_INDEX = pa.schema(
    [("page_id", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64())]
    + [("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64())]
)
_READ = pa.schema(
    [("page_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64())]
    + [("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
_HTTP = ("Content-Type", "application/http;msgtype=response")
#: Bytes that a reader holds of a file besides one record.
READ_BYTES = 1 << 20
#: Records whose rows a reader holds.
READ_RECORDS = 10_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record in a gzip member of its own."""
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in headers if v is not None)]
    lines.append(f"Content-Length: {len(block)}".encode())
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packed.compress(_END.join([*lines, b"", block, b"", b""])) + packed.flush()


def _members(file: pa.NativeFile) -> Iterator[bytes]:
    held = file.read(READ_BYTES)
    while held:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            held = held or file.read(READ_BYTES)
            if not held:
                raise EOFError("an archive ends within a record")
            parts.append(member.decompress(held))
            held = member.unused_data
        yield b"".join(parts)
        held = held or file.read(READ_BYTES)


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = record.partition(_END * 2)
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, block[: int(headers["Content-Length"])]


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _page(value: int | None) -> str | None:
    return None if value is None else str(value)


def _name(place: str, at: int | str) -> str:
    """The id of the record that was first written at that place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place}/{at}')}>"


class _Archive:
    """An archive that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str, date: str) -> None:
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.path, self.own, self.at, self.date = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}", 0, date
        self.out = self.store.open_output_stream(self.own, compression=None)
        about = [("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        self.put("warcinfo", about, b"format: WARC File Format 1.1\r\n", _name(self.path, "info"))

    def put(self, kind: str, headers: list[tuple[str, str | None]], block: bytes, record: str) -> tuple[int, int]:
        raw = _record(kind, [("WARC-Record-ID", record), ("WARC-Date", self.date), *headers], block)
        self.out.write(raw)
        self.at += len(raw)
        return self.at - len(raw), len(raw)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.own, self.path)


def _clean(uri: str | None) -> str | None:
    return None if uri is None else " ".join(uri.split())


def _put_response(to: _Archive, record: str, page: int | None, uri: str | None, digest: str, payload: bytes) -> tuple[int, int]:
    headers = [("WARC-Target-URI", _clean(uri)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", _page(page)), _HTTP]
    return to.put("response", headers, _http(len(payload)) + payload, record)


def _put_revisit(to: _Archive, r: dict) -> None:
    """r: a row of resolve(). The response that it refers to has the date that all records of the new archives have."""
    refers = [
        ("WARC-Refers-To", _name(r["response_archive"], r["response_at"])),
        ("WARC-Refers-To-Target-URI", _clean(r["response_uri"])),
        ("WARC-Refers-To-Date", to.date),
        ("X-Refers-To-Page-Id", _page(r["response_id"])),
    ]
    own = [("WARC-Target-URI", _clean(r["uri"])), ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("WARC-Profile", PROFILE)]
    headers = [*own, *refers, ("X-Page-Id", _page(r["page_id"])), _HTTP]
    to.put("revisit", headers, _http(r["payload_bytes"]), _name(r["archive"], r["at"]))


def _date() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(
    pages: DataFrame, folder: str | None = None, date: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Writes a response record for each row, an archive per partition; returns the index of their headers.

    Payload: the text in UTF-8, empty for null. Index: page_id, uri, digest (base32 SHA-1), payload_bytes, archive,
    at, size. folder: any store that pyarrow.fs opens. Null ids and addresses are left out of the headers; other
    columns are ignored; an empty table gives no archives. A task that runs again writes an archive of its own, and
    the index names the one of the attempt that counted.
    """
    spark = pages.sparkSession
    ready(spark)
    folder, date = folder or new_folder(spark, "warc"), date or _date()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = None
        for batch in batches:
            for block in blocks(batch, "text"):
                task = TaskContext.get()
                to = to or _Archive(folder, f"raw-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", date)
                rows = []
                for page, uri, text in zip(*(block.column(c).to_pylist() for c in ("page_id", "uri", "text")), strict=True):
                    payload = (text or "").encode()
                    digest = payload_digest(payload)
                    at, size = _put_response(to, _name(to.path, to.at), page, uri, digest, payload)
                    rows.append((page, uri, digest, len(payload), to.path, at, size))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
        if to:
            to.close()

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{uri_col}`").alias("uri"), F.col(f"`{payload_col}`").alias("text"))
    kinds = "page_id long, uri string, digest string, payload_bytes long, archive string, at long, size long"
    return materialize(rows.mapInArrow(write, kinds), "headers").withColumn("folder", F.lit(folder))


def resolve(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds record_type and, of the response that a revisit refers to, response_id, _uri, _archive and _at to the headers.

    Only headers are shuffled, by payload digest; the responses are found by partial maxima, and their table is
    written, so that the join's other side, which a hot digest may fill, can be split. Of records whose equal payloads
    have least_bytes bytes or more, that with the largest page_id stays a response, and so does any that repeats its
    page_id; the others become its revisits. Smaller payloads all stay. A null page_id is smaller than any other.
    """
    fields = {"page_id": "response_id", "uri": "response_uri", "archive": "response_archive", "at": "response_at"}
    large = F.col("payload_bytes") >= least_bytes
    first = index.filter(large).groupBy("digest").agg(F.max(F.struct(*fields)).alias("response"))
    joined = index.join(materialize(first, "responses"), "digest", "left")
    again = large & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response.page_id"))
    found = [F.when(again, F.col(f"response.{c}")).alias(name) for c, name in fields.items()]
    return joined.select(index["*"], F.when(again, "revisit").otherwise("response").alias("record_type"), *found)


def rewrite_archives(resolved: DataFrame, folder: str | None = None, date: str | None = None) -> DataFrame:
    """Writes each archive anew with fresh headers, revisits without their payload; returns the archives written.

    A task goes through an archive once, in the order of its records; a revisit names the id, address and date of its
    response. Nulls and empty payloads are as write_archives and resolve have them; no headers give no archives.
    """
    spark = resolved.sparkSession
    folder, date = folder or new_folder(spark, "warc"), date or _date()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for (source, path), own in groupby(rows, lambda r: (r["folder"], r["archive"])):
            store, _ = fs.FileSystem.from_uri(source)
            to = _Archive(folder, path.rsplit("/", 1)[-1].replace("raw-", "dedup-"), date)
            with store.open_input_file(path) as raw:
                for r in own:
                    if r["record_type"] == "revisit":
                        _put_revisit(to, r)
                        continue
                    _, block = _parse(zlib.decompress(raw.read_at(r["size"], r["at"]), 31))
                    _put_response(to, _name(path, r["at"]), r["page_id"], r["uri"], r["digest"], block.partition(_END * 2)[2])
            to.close()
            yield pa.RecordBatch.from_pylist([{"archive": to.path, "folder": folder}])

    ordered = spread(resolved, "archive").sortWithinPartitions("archive", "at")
    return materialize(ordered.mapInArrow(write, "archive string, folder string"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """The response and revisit records of archives: page_id, uri, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest are those of the full payload; a response's are computed from what is read. A task reads an
    archive, record by record, and gives its rows in parts. Ids and addresses that a record lacks are null; no
    archives give no rows.
    """
    ready(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            store, _ = fs.FileSystem.from_uri(row["folder"])
            with store.open_input_stream(row["archive"], compression=None) as f:
                records = (x for x in map(_parse, _members(f)) if x[0]["WARC-Type"] != "warcinfo")
                while found := [_judged(*x) for x in islice(records, READ_RECORDS)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), _READ, strict=True)], schema=_READ)

    kinds = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spread(archives, "archive").mapInArrow(read, kinds)


def _judged(headers: dict[str, str], block: bytes) -> tuple:
    """A row of read_archives."""
    kind = headers["WARC-Type"]
    http, _, payload = block.partition(_END * 2)
    if kind == "response":
        size, digest = len(payload), payload_digest(payload)
    else:
        size, digest = int(http.rsplit(b"Content-Length: ", 1)[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    page, refers = (None if (x := headers.get(k)) is None else int(x) for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
    return page, headers.get("WARC-Target-URI"), size, digest, kind, refers
