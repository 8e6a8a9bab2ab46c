"""The benchmark: strategies by seed as runs of their own, summed up and held against gates."""

from __future__ import annotations

import dataclasses
import statistics
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from premia.advisor import PolicyAdvisor
from premia.config import Config
from premia.errors import ConfigError
from premia.journal import Journal
from premia.plans.runs import summary
from premia.provider import Quote
from premia.run import MappingRun
from premia.sources.files import write_csv, write_json

# Seeds, and the gates' bounds.
SEEDS = (11, 23, 37, 53, 71)
LEAST_GAIN, MOST_LATENCY_RISE = 0.10, 0.20
# Mapping rows of the full and the reduced budget, and the hybrid gates' bounds.
FULL, REDUCED = 260, 208
LEAST_SAVING, LEAST_ABLATION_GAIN, MOST_SEED_LOSS = 0.20, 0.05, 0.10
_RECORD = "strategy string, seed long, mae double, latency_ms double, coverage double, eligible long"


def run_benchmark(spark: SparkSession, config: Config, folder: str | Path, strategies: tuple[str, ...] = ("random", "lhs", "active"), seeds: tuple[int, ...] = SEEDS, provider: Quote | None = None, baseline_ms: float | None = None) -> dict[str, Any]:
    """Runs each strategy with each seed at the same budget; writes records.csv and summary.json; returns the summary.

    A run is a sequence of Spark jobs whose tasks are candidates, members and partitions.
    """
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    rows = []
    for strategy in strategies:
        for seed in seeds:
            own = dataclasses.replace(config, sampling=dataclasses.replace(config.sampling, strategy=strategy, seed=seed))
            found = MappingRun(spark, own, f"bench-{strategy}-{seed}", provider).run()
            report = found.report
            rows.append((strategy, seed, report["metrics"]["mae"], report["latency_ms"], report["interval"]["coverage"], int(report["gates"]["latency"])))
    records = spark.createDataFrame(rows, _RECORD)
    write_csv(records.orderBy("strategy", "seed"), folder / "records.csv")
    table = {r["strategy"]: r.asDict() for r in summary(records).collect()}
    judged = gates(table, config.evaluation.least_coverage, config.evaluation.most_coverage, baseline_ms)
    write_json({"summary": table, "gates": judged}, folder / "summary.json")
    return {"summary": table, "gates": judged}


def gates(table: dict[str, dict[str, Any]], least: float, most: float, baseline_ms: float | None = None) -> dict[str, bool]:
    """Whether active beats lhs by LEAST_GAIN in median MAE, covers, and is no slower than the baseline allows."""
    active, lhs = table["active"], table["lhs"]
    found = {"mae": (lhs["median_mae"] - active["median_mae"]) / lhs["median_mae"] >= LEAST_GAIN, "coverage": least <= active["mean_coverage"] <= most}
    if baseline_ms is not None:
        found["latency"] = active["median_latency"] <= baseline_ms * (1 + MOST_LATENCY_RISE)
    return found


def paired_gains(records: Any) -> Any:
    """By seed: the relative gain of the hybrid over the Bayesian strategy."""
    wide = records.groupBy("seed").pivot("strategy", ["hybrid", "bayesian"]).agg(F.first("mae"))
    return wide.select("seed", ((F.col("bayesian") - F.col("hybrid")) / F.nullif(F.col("bayesian"), F.lit(0.0))).alias("gain"))


def run_hybrid_benchmark(spark: SparkSession, config: Config, folder: str | Path, seeds: tuple[int, ...] = SEEDS, provider: Quote | None = None, advisor: PolicyAdvisor | None = None, budgets: tuple[int, int] = (FULL, REDUCED)) -> dict[str, Any]:
    """Active at the full budget against Bayesian and hybrid at the reduced one, by seed; writes records.csv and summary.json.

    An artifact is checked when it is exported, so that every run that ends has a sound one.
    """
    if config.advisor is None:
        raise ConfigError("the hybrid benchmark needs an advisor")
    if budgets[1] < config.sampling.initial_size:
        raise ConfigError("the reduced budget must not be below initial_size")
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    rows: list[dict[str, Any]] = []
    for strategy, budget in (("active", budgets[0]), ("bayesian", budgets[1]), ("hybrid", budgets[1])):
        for seed in seeds:
            own = dataclasses.replace(config, sampling=dataclasses.replace(config.sampling, strategy=strategy, seed=seed, mapping_budget=budget))
            run = MappingRun(spark, own, f"bench-{strategy}-{seed}", provider, advisor if strategy == "hybrid" else None)
            found = run.run()
            sampled = Journal(spark, run.folder, {}).table("samples").filter("split = 'mapping'").count()
            asked = found.report.get("advisor", {})
            figures = {"mae": found.report["metrics"]["mae"], "latency_ms": found.report["latency_ms"], "coverage": found.report["interval"]["coverage"]}
            of_advisor = {"advisor_ms": asked.get("maximum_latency_ms", 0.0), "advisor_bytes": asked.get("maximum_resident_bytes", 0), "advisor_latency": asked.get("latency_passed", True), "advisor_memory": asked.get("memory_passed", True)}
            rows.append({"strategy": strategy, "seed": seed, **figures, **of_advisor, "eligible": all(found.report["gates"].values()), "samples": sampled})
    found = {"records": rows, "gates": hybrid_gates(rows, budgets)}
    write_csv(spark.createDataFrame(pd.DataFrame(rows)).orderBy("strategy", "seed"), folder / "records.csv")
    write_json(found, folder / "summary.json")
    return found


def hybrid_gates(rows: list[dict[str, Any]], budgets: tuple[int, int] = (FULL, REDUCED)) -> dict[str, Any]:
    """Whether the hybrid strategy may replace the Bayesian one; `passed` only if every other gate is."""
    mae = {s: {r["seed"]: r["mae"] for r in rows if r["strategy"] == s} for s in ("active", "bayesian", "hybrid")}
    median = {s: statistics.median(v.values()) for s, v in mae.items()}
    most = dict(zip(mae, (budgets[0], *budgets[1:] * 2), strict=True))
    hybrid = [r for r in rows if r["strategy"] == "hybrid"]
    loss = {str(k): -gain(v, mae["hybrid"][k]) for k, v in mae["bayesian"].items()}
    saved = 1 - budgets[1] / budgets[0]
    within = all(r["samples"] == most["active"] if r["strategy"] == "active" else r["samples"] <= most[r["strategy"]] for r in rows)
    judged = {
        "budget": within,
        "efficiency": within and saved >= LEAST_SAVING - 1e-12 and median["hybrid"] <= median["active"],
        "ablation": gain(median["bayesian"], median["hybrid"]) >= LEAST_ABLATION_GAIN,
        "seeds": all(v <= MOST_SEED_LOSS for v in loss.values()),
        "eligible": all(r["eligible"] for r in hybrid),
        "latency": all(r["advisor_latency"] for r in hybrid),
        "memory": all(r["advisor_memory"] for r in hybrid),
    }
    passed = all(judged.values())
    figures = {"saving": saved, "gain_over_active": gain(median["active"], median["hybrid"]), "gain_over_bayesian": gain(median["bayesian"], median["hybrid"]), "loss_by_seed": loss}
    return judged | {"passed": passed, "strategy": "hybrid" if passed else "bayesian", "figures": figures}


def gain(before: float, after: float) -> float:
    """The relative fall of an error; 0 where there was none."""
    return (before - after) / before if before else 0.0
