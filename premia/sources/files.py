"""Quote rows from CSV and JSON files, read strictly; datasets and predictions written back."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.errors import SourceError
from premia.operators.encode import row_key
from premia.operators.validate import parse_number, reject_reasons, target_ok
from premia.schema import CATEGORICAL, FIELD_ORDER, INTEGER, SPLITS, Domain, quote_schema


def _cells(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """A CSV file's cells as text; the header must be those columns in that order, and every row as long."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("emptyValue", "").option("nullValue", "\u0000")
    try:
        held = reader.csv(path)
        held.limit(1).count()
    except (PySparkException, Py4JError) as e:
        raise SourceError(f"{path}: {str(e).splitlines()[0]}") from e
    return held


def _typed(cells: DataFrame) -> DataFrame:
    numbers = {c: parse_number(F.col(c), c in INTEGER) for c in FIELD_ORDER if c not in CATEGORICAL}
    return cells.withColumns(numbers)


def _first_problem(rows: DataFrame, problems: Mapping[str, Any]) -> str | None:
    """The name of the first rule that any row breaks; one pass counts them all."""
    try:
        counts = rows.agg(F.count("*").alias("rows"), *(F.count_if(rule).alias(name) for name, rule in problems.items())).first()
    except (PySparkException, Py4JError) as e:
        raise SourceError(f"malformed rows: {str(e).splitlines()[0]}") from e
    return "no rows" if not counts["rows"] else next((n for n in problems if counts[n]), None)


def read_quotes(spark: SparkSession, path: str, domain: Domain | None = None) -> DataFrame:
    """Exactly the 15 columns, typed and within the domain; any bad row raises."""
    rows = _typed(_cells(spark, path, FIELD_ORDER))
    if problem := _first_problem(rows, {"outside the domain": reject_reasons(domain) != ""}):
        raise SourceError(f"{path}: {problem}")
    return rows


def read_seed(spark: SparkSession, path: str, domain: Domain | None = None) -> DataFrame:
    """The 15 columns and a premium of each row; keys must be distinct."""
    rows = _typed(_cells(spark, path, [*FIELD_ORDER, "premium"])).withColumn("premium", parse_number(F.col("premium"), False))
    if problem := _first_problem(rows, {"outside the domain": reject_reasons(domain) != "", "not a premium": ~F.coalesce(target_ok(F.col("premium")), F.lit(False))}):
        raise SourceError(f"{path}: {problem}")
    _no_repeats(rows, path)
    return rows


def _no_repeats(rows: DataFrame, path: str) -> None:
    if rows.groupBy(row_key().alias("k")).count().filter("count > 1").head():
        raise SourceError(f"{path}: a row repeats")


def read_dataset(spark: SparkSession, path: str, domain: Domain | None = None, counts: Mapping[str, int] | None = None) -> DataFrame:
    """An artifact's dataset: 15 columns, premium, split, source. Whole numbers must be written without a fraction."""
    cells = _cells(spark, path, [*FIELD_ORDER, "premium", "split", "source"])
    written = F.lit(True)
    for name in INTEGER:
        written = written & F.col(name).rlike("^-?[0-9]+$")
    rows = _typed(cells.withColumn("__written", written)).withColumn("premium", parse_number(F.col("premium"), False))
    rules = {
        "a whole number with a fraction": ~F.col("__written"), "outside the domain": reject_reasons(domain) != "", "not a premium": ~F.coalesce(target_ok(F.col("premium")), F.lit(False)),
        "unknown split": ~F.col("split").isin(*SPLITS), "no source": F.coalesce(F.trim("source"), F.lit("")) == "",
    }
    if problem := _first_problem(rows, rules):
        raise SourceError(f"{path}: {problem}")
    _no_repeats(rows, path)
    have = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    if counts is not None and any(have.get(s, 0) != counts.get(s, 0) for s in SPLITS):
        raise SourceError(f"{path}: rows by split are {have}, not {dict(counts)}")
    return rows.drop("__written")


def audit_rows(dataset: DataFrame) -> DataFrame:
    rows = dataset.filter("split = 'audit'")
    if rows.head() is None:
        raise SourceError("the dataset has no audit rows")
    return rows


def write_csv(rows: DataFrame, path: str | Path) -> None:
    """rows as one CSV file with a header, which appears whole or not at all.

    Parts are written side by side, then the driver strings them together in their order, a block at a time.
    """
    target = Path(path)
    own = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
    try:
        rows.write.option("emptyValue", "").csv(own.resolve().as_uri())
        whole = own / "whole"
        with whole.open("wb") as out:
            out.write((",".join(rows.columns) + "\n").encode())
            for part in sorted(own.glob("part-*.csv"), key=lambda p: int(p.name.split("-")[1])):
                with part.open("rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
        os.replace(whole, target)
    finally:
        shutil.rmtree(own, ignore_errors=True)


def write_json(value: Any, path: str | Path) -> None:
    """Sorted keys, no NaN, replaced in one step."""
    target = Path(path)
    own = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
    with own.open("w") as f:
        json.dump(value, f, indent=2, sort_keys=True, allow_nan=False)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(own, target)


def strict_json(raw: str | bytes) -> Any:
    """JSON without repeated keys and without NaN or infinities."""

    def pairs(found: list[tuple[str, Any]]) -> dict[str, Any]:
        if len({k for k, _ in found}) != len(found):
            raise SourceError("a key repeats")
        return dict(found)

    def constant(name: str) -> None:
        raise SourceError(f"{name} isn't allowed")

    try:
        return json.loads(raw, object_pairs_hook=pairs, parse_constant=constant)
    except (json.JSONDecodeError, UnicodeDecodeError) as e:
        raise SourceError(f"not JSON: {e}") from e


def quote_rows(spark: SparkSession, rows: list[Mapping[str, Any]], domain: Domain | None = None) -> DataFrame:
    """Mappings as quote rows: nothing missing, unknown or of another type (True is no number), all within the domain."""
    for row in rows:
        if set(row) != set(FIELD_ORDER):
            raise SourceError(f"fields missing or unknown: {sorted(set(row) ^ set(FIELD_ORDER))}")
        for name, value in row.items():
            kinds = str if name in CATEGORICAL else int if name in INTEGER else (int, float)
            if isinstance(value, bool) or not isinstance(value, kinds):
                raise SourceError(f"{name}: not of its type")
    values = [tuple(float(r[n]) if n not in INTEGER and n not in CATEGORICAL else r[n] for n in FIELD_ORDER) for r in rows]
    found = spark.createDataFrame(values, quote_schema())
    if bad := found.withColumn("why", reject_reasons(domain)).filter("why <> ''").head():
        raise SourceError(f"row rejected: {bad['why']}")
    return found
