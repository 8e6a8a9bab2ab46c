"""Token-id files: ids one after the other, document boundaries and ids of documents in Elias-Fano code."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premia.llm import tokens
from premia.llm.eliasfano import EliasFano, encode
from premia.llm.shared import blocks, materialize, new_folder, ready, spread

_TAIL = struct.Struct("<8sBxxxxxxxQQQQQ")  # mark, bytes an id, documents, of them without doc_id, ids, bytes of the boundaries, of the doc_ids
MARK = b"EFTOKENS"
#: Documents whose ids are read at once.
READ_DOCS = 512


class TokenFile:
    """A token-id file: `documents` and `ids` count its contents; starts and doc_ids are asked for by position."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        size = file.size()
        mark, self.width, self.documents, self.nulls, self.ids, ends, names = _TAIL.unpack(file.read_at(_TAIL.size, size - _TAIL.size))
        if mark != MARK:
            raise ValueError("not a token-id file")
        at = self.ids * self.width
        self.ends = EliasFano(file.read_at(ends, at))
        self.names = EliasFano(file.read_at(names, at + ends))

    def starts(self, start: int, stop: int) -> np.ndarray:
        """Where documents start to stop - 1 begin, and where the last of them ends."""
        ends = self.ends.slice(max(start - 1, 0), stop)
        return ends if start else np.concatenate([[0], ends])

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        nulls = min(max(self.nulls - start, 0), stop - start)
        return [None] * nulls + self.names.slice(start + nulls - self.nulls, stop - self.nulls).tolist()

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file."""
        return np.frombuffer(self.file.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}")


def _write(batches: Iterator[pa.RecordBatch], shard: int, folder: str, tokenizer: str, end: int) -> tuple[str, int, int] | None:
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    final, own = f"{root}/shard-{shard:06d}.eftok", f"{root}/.{shard}-{uuid.uuid4().hex}"
    lengths: list[int] = []
    names: list[int] = []
    enc = tokens.encoder(tokenizer)
    with store.open_output_stream(own) as out:
        for batch in batches:
            for block in blocks(batch, "text"):
                found = enc.encode([x or "" for x in block.column("text").to_pylist()], end)
                out.write(np.concatenate(found).tobytes())
                lengths += map(len, found)
                names += [x for x in block.column("doc_id").to_pylist() if x is not None]
        ends, ids = encode(np.cumsum(np.array(lengths, np.int64))), encode(np.array(names, np.int64))
        nulls = len(lengths) - len(names)
        out.write(ends + ids + _TAIL.pack(MARK, enc.dtype.itemsize, len(lengths), nulls, sum(lengths), len(ends), len(ids)))
    if not lengths:
        store.delete_file(own)
        return None
    store.move(own, final)  # a task that runs again replaces the file by an equal one
    return final, len(lengths), sum(lengths)


def write_token_files(
    docs: DataFrame, tokenizer: str, end: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes docs in ascending order of id to token-id files; returns their manifest: shard, path, documents, ids, start.

    tokenizer: a tokenizers file that all executors have. Each text's ids are followed by `end`. folder: any store
    that pyarrow.fs opens, by default one in the shared folder. Documents without an id come first; a null text is
    empty; documents that repeat an id stay, in a fixed order; other columns are ignored; an empty table gives no
    files. start: ids in all files before.
    """
    spark = docs.sparkSession
    ready(spark)
    folder = folder or new_folder(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        if found := _write(batches, shard, folder, tokenizer, end):
            kinds = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": found[0], "documents": found[1], "ids": found[2]}], kinds)

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # the hash parts documents that repeat an id, so that none of them, nor null, fills one file
    ordered = texts.withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    manifest = materialize(ordered.drop("hash").mapInArrow(write, "shard int, path string, documents long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.select("*", F.lit(folder).alias("folder"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest back, a task for each: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ids_crc32: unsigned crc32 of the document's ids as little-endian unsigned 32-bit integers. A document without an
    id has doc_id null; an empty document has its end id alone; an empty manifest gives no rows.
    """
    ready(manifest.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            store, _ = fs.FileSystem.from_uri(row["folder"])
            with store.open_input_file(row["path"]) as f:
                file = TokenFile(f)
                for at in range(0, file.documents, READ_DOCS):
                    stop = min(at + READ_DOCS, file.documents)
                    bounds = file.starts(at, stop)
                    cuts = (bounds - bounds[0]).tolist()
                    held = file.tokens(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    crcs = [zlib.crc32(held[a:b]) for a, b in zip(cuts, cuts[1:])]
                    columns = (file.doc_ids(at, stop), bounds[:-1] + row["start"], np.diff(bounds), crcs)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    rows = spread(manifest.select("path", "folder", "start"), "path")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
