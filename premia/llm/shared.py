"""Folders, intermediate tables and text helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import string
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handled at once in a Python worker: rows and UTF-8 bytes.
BLOCK_ROWS, BLOCK_BYTES = 1000, 4 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_held: dict[Hashable, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset.

    Only a session whose executors are threads of the driver gets one of our own; elsewhere it would be another
    folder on each machine, so that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/premia-checkpoints"
        os.makedirs(root.removeprefix("file://"), exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/premia-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back, which cuts its lineage.

    The table outlives any executor. Its folder belongs to the job and goes with spark.checkpoint.dir.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions inside hand Python workers at most BLOCK_ROWS rows at once; else a batch of whole texts takes much memory on both sides."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BLOCK_ROWS:
        spark.conf.set(_BATCH, str(BLOCK_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's own object of that key, which its later tasks find.

    Only the one that was used last stays: a worker outlives its stage, and what other stages' operators made would add up.
    """
    if key not in _held:
        _held.clear()
        gc.collect()  # an encoder and its pieces refer to each other
        trim()
        _held[key] = make()
    return _held[key]


def trim() -> None:
    """Gives this process's free memory back to the system, where the C library can; else a worker keeps the most it ever took."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and trim() when a task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows, of which few are and each means much work, in a partition for each value of key."""
    return rows.repartitionByRange(max(1, rows.select(key).distinct().count()), key)


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package when it was found by a path of the driver's own."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one, named row, so that none of their names clashes with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def ascii_lower(text: Column) -> Column:
    """text with A-Z, and no other letter, in lower case. Where all is ASCII, lower() is that and much faster."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(folded)


def word_count(text: Column) -> Column:
    """Words in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_of(column: Column, buckets: int) -> Column:
    """crc32 of the column as text, modulo buckets."""
    return F.crc32(column.cast("string").cast("binary")) % buckets


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most BLOCK_ROWS rows and about BLOCK_BYTES bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for row, size in enumerate(sizes):
        if row > start and (row - start >= BLOCK_ROWS or held + size > BLOCK_BYTES):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)
