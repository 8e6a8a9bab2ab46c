"""A run's journal: append-only Parquet tables that appear version by version, and the lock of the run."""

from __future__ import annotations

import fcntl
import os
import re
import shutil
import uuid
from collections.abc import Mapping
from pathlib import Path
from typing import Any, Self

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.errors import JournalError, RunLocked
from premia.operators import journal as steps
from premia.operators.validate import RUN_ID
from premia.schema import quote_schema
from premia.sources.files import strict_json, write_json

SAMPLES = T.StructType([T.StructField("id", T.LongType()), T.StructField("split", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("row_key", T.StringType()), T.StructField("source", T.StringType()), *quote_schema().fields])
QUOTES = T.StructType([T.StructField("provider_identity", T.StringType()), T.StructField("row_key", T.StringType()), T.StructField("premium", T.DoubleType())])
ATTEMPTS = T.StructType([T.StructField("row_key", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("outcome", T.StringType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("error_type", T.StringType()), T.StructField("at", T.StringType())])
BATCHES = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("version", T.LongType()), T.StructField("state", T.StringType()), T.StructField("mae", T.DoubleType()), T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType()), T.StructField("policy", T.StringType())])
DECISIONS = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("seed", T.LongType()), T.StructField("policy", T.StringType()), T.StructField("boosts", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("runtime", T.StringType()), T.StructField("request_digest", T.StringType()), T.StructField("response_digest", T.StringType()), T.StructField("attempt_latencies", T.ArrayType(T.DoubleType())), T.StructField("resident_bytes", T.LongType()),
])
TABLES = {"samples": SAMPLES, "quotes": QUOTES, "attempts": ATTEMPTS, "batches": BATCHES, "decisions": DECISIONS}


class RunLock:
    """Held by the one process that works on a run."""

    def __init__(self, folder: Path) -> None:
        self.path = folder / "lock"

    def __enter__(self) -> Self:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.file = self.path.open("w")
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self.file.close()
            raise RunLocked(f"{self.path.parent.name}: another process works on this run") from e
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


class Journal:
    """The tables of one run in a folder that driver and executors share.

    A version is written beside the table and renamed into it, so that a crash leaves it whole or out. What is
    there is never changed: a quote is a row of its own, and the latest version of a batch counts.
    """

    def __init__(self, spark: SparkSession, folder: str | Path, metadata: Mapping[str, Any]) -> None:
        self.spark, self.folder, self.metadata = spark, Path(folder).resolve(), dict(metadata)

    @classmethod
    def create(cls, spark: SparkSession, folder: str | Path, metadata: Mapping[str, Any]) -> Journal:
        folder = Path(folder)
        if not re.match(RUN_ID, folder.name):
            raise JournalError(f"{folder.name!r} can't name a run")
        if (folder / "run.json").exists():
            raise JournalError(f"{folder.name}: the run exists")
        folder.mkdir(parents=True, exist_ok=True)
        write_json(dict(metadata), folder / "run.json")
        return cls(spark, folder, metadata)

    @classmethod
    def open(cls, spark: SparkSession, folder: str | Path, metadata: Mapping[str, Any]) -> Journal:
        """An existing run, if it was begun with the same metadata."""
        path = Path(folder) / "run.json"
        if not path.exists():
            raise JournalError(f"{Path(folder).name}: no such run")
        held = strict_json(path.read_text())
        if different := sorted(k for k in held.keys() | metadata.keys() if held.get(k) != metadata.get(k)):
            raise JournalError(f"the run was begun with another {', '.join(different)}")
        return cls(spark, folder, held)

    def append(self, table: str, rows: DataFrame) -> None:
        versions = self.folder / table
        versions.mkdir(exist_ok=True)
        last = max((int(p.name[2:]) for p in versions.glob("v=*")), default=-1)
        own = self.folder / f".{table}-{uuid.uuid4().hex}"
        try:
            rows.select(*TABLES[table].names).write.parquet(f"file://{own}")
            os.rename(own, versions / f"v={last + 1:06d}")
        finally:
            shutil.rmtree(own, ignore_errors=True)

    def table(self, name: str) -> DataFrame:
        found = sorted((self.folder / name).glob("v=*"))
        if not found:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"file://{p}" for p in found))

    def samples(self) -> DataFrame:
        """Samples with premium and status."""
        quotes = self.table("quotes").filter(F.col("provider_identity") == self.metadata["provider"]).groupBy("row_key").agg(F.min("premium").alias("premium"))
        both = self.table("samples").join(quotes, "row_key", "left")
        return both.withColumn("status", F.when(F.col("premium").isNull(), "pending").otherwise("complete"))

    def batches(self) -> DataFrame:
        return steps.latest(self.table("batches"), ["batch_id"], "version")

    def register(self, rows: DataFrame) -> None:
        """New samples; none may repeat a key that is there."""
        twice = rows.select("row_key").join(self.table("samples").select("row_key"), "row_key", "left_semi").head()
        if twice or rows.groupBy("row_key").count().filter("count > 1").head():
            raise JournalError("a sample repeats")
        self.append("samples", rows)

    def validate(self) -> None:
        """Raises unless every row is unaltered, unique, within the domain and consistent."""
        found = steps.integrity(self.samples()).first()
        if bad := [k for k in ("altered", "outside", "inconsistent", "repeated") if found[k]]:
            raise JournalError(f"the journal has rows that are {', '.join(bad)}")
        conflicts = self.table("quotes").groupBy("provider_identity", "row_key").agg(F.min("premium").alias("a"), F.max("premium").alias("b")).filter("a <> b")
        if conflicts.head():
            raise JournalError("two quotes of a row differ")
