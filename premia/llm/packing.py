"""Packing of token ids into sequences: bounded-space online best fit, leftovers merged at the end."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm import tokens
from premia.llm.shared import blocks, materialize, ready, small_batches, trimmed

#: A piece: document, ids before it, ids, the document's ids.
Piece = tuple[int | None, int, np.ndarray, int]
_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Partitions whose leftovers one task merges: at most so many windows.
MERGED_PARTITIONS = 128


class Windows:
    """At most `most` open windows of `capacity` ids; full() holds those that are emitted."""

    def __init__(self, capacity: int, most: int, top_up: int) -> None:
        self.capacity, self.most, self.top_up = capacity, most, top_up
        self.open: list[tuple[int, int]] = []  # fill and key, in ascending order
        self.pieces: dict[int, list[Piece]] = {}
        self.key = 0
        self.done: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        """Cuts off whole windows, then puts the rest where the smallest gap is left."""
        doc, start, ids, total = piece
        while len(ids) >= self.capacity:
            self.done.append([(doc, start, ids[: self.capacity], total)])
            start, ids = start + self.capacity, ids[self.capacity :]
        while len(ids):
            at = bisect_right(self.open, (self.capacity - len(ids), 1 << 62)) - 1
            if at < 0 and len(self.open) < self.most:
                self.key += 1
                self.pieces[self.key] = []
                fill, key = 0, self.key
            else:
                fill, key = self.open.pop(at)  # at -1, none fits: the fullest goes
            part = ids[: self.capacity - fill]
            if at < 0 and fill and len(part) < self.top_up:
                part = part[:0]
            if len(part):
                self.pieces[key].append((doc, start, part, total))
            if at < 0 and fill or fill + len(part) == self.capacity:
                self.done.append(self.pieces.pop(key))
            else:
                insort(self.open, (fill + len(part), key))
            start, ids = start + len(part), ids[len(part) :]

    def take(self) -> list[list[Piece]]:
        done, self.done = self.done, []
        return done

    def rest(self) -> list[Piece]:
        """The pieces of all windows that are still open, fullest window first."""
        found = [p for _, key in reversed(self.open) for p in self.pieces[key]]
        self.open, self.pieces = [], {}
        return found


def merge(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows filled by the pieces one after the other; all but the last are full."""
    found: list[list[Piece]] = [[]]
    room = capacity
    for doc, start, ids, total in pieces:
        while len(ids):
            if not room:
                found.append([])
                room = capacity
            part = ids[:room]
            found[-1].append((doc, start, part, total))
            start, ids, room = start + len(part), ids[len(part) :], room - len(part)
    return found if found[0] else []


def _rows(windows: list[list[Piece]], first: int, with_ids: bool) -> list[tuple]:
    rows = []
    for i, window in enumerate(windows):
        offset = 0
        for doc, start, ids, total in window:
            raw = ids.astype("<u4").tobytes()
            rows.append((doc, start, len(ids), zlib.crc32(raw), total, first + i, offset, raw if with_ids else None))
            offset += len(ids)
    return rows


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 2048, open_windows: int = 64, top_up: int = 16, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Each text's ids and `end` are cut into pieces. A partition keeps open_windows windows; a piece goes where it
    leaves the smallest gap; if none has room, a new one opens or, when all are open, the fullest is topped up by
    a cut of top_up ids or more and emitted. At the end of a partition its open windows are merged into full ones,
    and what is left of MERGED_PARTITIONS partitions, less than a window each, is merged once more. ids: unsigned
    32-bit little-endian, null unless with_ids. Sequences are unpadded here: less than top_up ids are missing in
    any but the last of each merge. A null text is empty and still has its end id; repeated documents are packed
    again; null ids stay null; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("left", pa.int32())])

    def batch_of(rows: list[tuple], left: int | None) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([*columns, [left] * len(rows)], schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        first = partition << 32
        windows = Windows(capacity, open_windows, top_up)
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            for block in blocks(batch, "text"):
                found = enc.encode([x or "" for x in block.column("text").to_pylist()], end)
                for doc, ids in zip(block.column("doc_id").to_pylist(), found, strict=True):
                    windows.add((doc, 0, ids, len(ids)))
                done = windows.take()
                yield batch_of(_rows(done, first, with_ids), None)
                first += len(done)
        done = merge(windows.rest(), capacity)
        rest = [done.pop()] if done and sum(len(p[2]) for p in done[-1]) < capacity else []
        yield batch_of(_rows(done, first, with_ids), None)
        yield batch_of(_rows(rest, first + len(done), True), partition // MERGED_PARTITIONS)

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sequence_id", "offset"])
        pieces = [(None if pd.isna(d) else int(d), int(s), np.frombuffer(i, "<u4"), int(t)) for d, s, i, t in zip(rows.doc_id, rows.start, rows.ids, rows.doc_tokens, strict=True)]
        out = pd.DataFrame(_rows(merge(pieces, capacity), (1 << 62) + (int(key[0]) << 32), with_ids), columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        return out.astype({"doc_id": "Int64"})

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with small_batches(spark):
        pieces = materialize(texts.mapInArrow(trimmed(run), f"{_COLUMNS}, left int"), "pieces")
    rest = pieces.filter("left is not null").groupBy("left").applyInPandas(merged, _COLUMNS)
    return pieces.filter("left is null").drop("left").unionByName(rest).withColumnRenamed("doc_id", id_col)
