"""Model search on the cluster: one task per candidate, one per member of a committee; scoring by partition."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.errors import ModelSelectionError, SourceError
from premia.models.estimators import BOOSTED, EXTRA_TREES, FOREST, Estimator, GaussianProcess, fit
from premia.operators.acquire import DIMS
from premia.operators.encode import ordinal, scaled_one_hot
from premia.schema import FIELD_ORDER

# What candidates choose from, and offsets of seeds.
BOOSTED_GRID = {"learning_rate": (0.035, 0.05, 0.075, 0.10), "max_leaf_nodes": (15, 23, 31, 47), "min_samples_leaf": (5, 10, 15, 20), "l2_regularization": (0.0, 0.1, 0.5, 1.0)}
TREES_GRID = {"min_samples_leaf": (1, 2, 3, 5), "max_features": (0.65, 0.8, 1.0), "max_depth": (None, 12, 18, 28)}
CANDIDATE_SEED, REFIT_SEED, COMMITTEE_SEED, MEMBER_SEED, SEARCH_STREAM = 10_007, 900_001, 1_000_003, 7_919, 31_337
VECTOR = [f"v{i:02d}" for i in range(DIMS)]


@dataclass(frozen=True)
class Candidate:
    name: str
    kind: str
    parameters: dict[str, Any]
    monotone: bool
    seed: int


def candidates(iterations: int, seed: int, boosting: int = 180, trees: int = 180) -> list[Candidate]:
    """For each iteration a boosted model, the same with monotone bounds, and an extra-trees model."""
    rng = np.random.default_rng([seed, SEARCH_STREAM])
    found: list[Candidate] = []

    def put(name: str, kind: str, parameters: dict[str, Any], monotone: bool = False) -> None:
        found.append(Candidate(name, kind, parameters, monotone, seed + CANDIDATE_SEED * (len(found) + 1)))

    def draw(grid: dict[str, tuple]) -> dict[str, Any]:
        return {k: v[int(rng.integers(len(v)))] for k, v in grid.items()}

    for i in range(iterations):
        boosted = draw(BOOSTED_GRID) | {"max_iter": boosting}
        put(f"hgb-unconstrained-{i}", BOOSTED, boosted)
        put(f"hgb-monotonic-{i}", BOOSTED, boosted, True)
        put(f"extra-trees-{i}", EXTRA_TREES, draw(TREES_GRID) | {"n_estimators": trees})
    return found


def matrices(rows: DataFrame, most: int = 20_000, target: str = "premium") -> tuple[np.ndarray, np.ndarray]:
    """(ordinal fields, targets) of the rows of a run's split, whose budget bounds them; more than `most` raise."""
    held = rows.select(*ordinal(), F.col(target).alias("__y")).limit(most + 1).toPandas()
    if len(held) > most:
        raise SourceError(f"more than {most} rows for one model; raise `most` if a task can hold them")
    y = held["__y"].to_numpy(float)
    if not len(y) or not np.isfinite(y).all() or (y < 0).any():
        raise SourceError("targets must be there, finite and not negative")
    return held[list(FIELD_ORDER)].to_numpy(float), y


def latency_ms(model: Estimator, row: np.ndarray, repetitions: int) -> float:
    """p95 (higher) of single-row predictions on the model in memory, after three that don't count."""
    one, times = row.tolist(), []
    for k in range(3 + repetitions):
        start = time.perf_counter()
        model.predict_one(one)
        if k >= 3:
            times.append((time.perf_counter() - start) * 1000)
    return sorted(times)[int(np.ceil(0.95 * (len(times) - 1)))]


def search(spark: SparkSession, specs: list[Candidate], train: tuple[np.ndarray, np.ndarray], validation: tuple[np.ndarray, np.ndarray], repetitions: int = 100) -> DataFrame:
    """name, monotonic, mae, latency_ms, model (JSON) of each candidate, fitted one to a task."""
    by_name = {s.name: s for s in specs}
    (x, y), (vx, vy) = train, validation

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        spec = by_name[key[0]]
        model = fit(spec.kind, spec.parameters, x, y, spec.seed, spec.monotone)
        mae = float(np.abs(model.predict(vx) - vy).mean())
        return pd.DataFrame({"name": [spec.name], "monotonic": [spec.monotone], "mae": [mae], "latency_ms": [latency_ms(model, vx[0], repetitions)], "model": [json.dumps(model.to_dict())]})

    names = spark.createDataFrame([(s.name,) for s in specs], "name string").repartition(len(specs), "name")
    return names.groupBy("name").applyInPandas(run, "name string, monotonic boolean, mae double, latency_ms double, model string")


def choose(found: list[Any], ceiling: float) -> Any:
    """Of search's rows, the least by (mae, name) among those not slower than the ceiling; the clock breaks no tie."""
    fast = [r for r in found if r["latency_ms"] <= ceiling]
    if not fast:
        quickest = min(found, key=lambda r: r["latency_ms"])
        raise ModelSelectionError(f"no candidate within {ceiling} ms; the fastest is {quickest['name']} at {quickest['latency_ms']:.3f} ms")
    return min(fast, key=lambda r: (r["mae"], r["name"]))


def refit(spec: Candidate, rows: np.ndarray, targets: np.ndarray, seed: int) -> Estimator:
    return fit(spec.kind, spec.parameters, rows, targets, seed + REFIT_SEED, spec.monotone)


def score(rows: DataFrame, model: Estimator, key: str = "quote_id") -> DataFrame:
    """key and predicted; encoding runs in the JVM, prediction by Arrow batch, and nothing is shuffled.

    The key may be of any type, as a struct of all columns that are to be kept beside a prediction.
    """
    wide = rows.select(F.col(key).alias("__key"), *ordinal())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in FIELD_ORDER]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(model.predict(np.stack(values, axis=1)))], names=["__key", "predicted"])

    kinds = T.StructType([T.StructField("__key", wide.schema["__key"].dataType), T.StructField("predicted", T.DoubleType())])
    return wide.mapInArrow(run, kinds).withColumnRenamed("__key", key)


def committee(spark: SparkSession, train: tuple[np.ndarray, np.ndarray], seed: int, members: int = 5, trees: int = 60) -> list[Estimator]:
    """Random forests that differ by seed, fitted one to a task."""
    x, y = train
    least = max(1, min(3, len(y) // 10 or 1))

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        own = seed + COMMITTEE_SEED * len(y) + MEMBER_SEED * int(key[0])
        model = fit(FOREST, {"n_estimators": trees, "max_features": 0.8, "min_samples_leaf": least}, x, y, own % (1 << 32))
        return pd.DataFrame({"member": [int(key[0])], "model": [json.dumps(model.to_dict())]})

    rows = spark.range(members).withColumnRenamed("id", "member").repartition(members, "member")
    found = rows.groupBy("member").applyInPandas(run, "member long, model string").collect()
    return [Estimator.from_dict(json.loads(r.model)) for r in sorted(found, key=lambda r: r.member)]


def spread(rows: DataFrame, members: list[Estimator], key: str = "quote_id") -> DataFrame:
    """key, mean, uncertainty (population deviation) over a committee's predictions."""
    wide = rows.select(F.col(key).alias("__key"), *ordinal())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.stack([m.predict(batch[list(FIELD_ORDER)].to_numpy(float)) for m in members])
            yield pd.DataFrame({"__key": batch["__key"], "mean": found.mean(0), "uncertainty": found.std(0)})

    kind = wide.schema["__key"].dataType.simpleString()
    return wide.mapInPandas(run, f"__key {kind}, mean double, uncertainty double").withColumnRenamed("__key", key)


def gp_spread(rows: DataFrame, train: DataFrame, key: str = "quote_id", most: int = 1000) -> DataFrame:
    """key, mean, uncertainty of a Gaussian process on the training rows, at most `most` of them."""
    held = train.select(*scaled_one_hot(), "premium").limit(most + 1).toPandas()
    if len(held) > most:
        raise SourceError(f"more than {most} rows for one Gaussian process")
    model = GaussianProcess().fit(held[VECTOR].to_numpy(), held["premium"].to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                mean, deviation = model.predict(part[VECTOR].to_numpy())
                yield pd.DataFrame({"__key": part["__key"], "mean": mean, "uncertainty": deviation})

    wide = rows.select(F.col(key).alias("__key"), *scaled_one_hot())
    kind = wide.schema["__key"].dataType.simpleString()
    return wide.mapInPandas(run, f"__key {kind}, mean double, uncertainty double").withColumnRenamed("__key", key)
