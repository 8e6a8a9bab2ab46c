"""Command line: config validate, map run|resume, model evaluate, predict row|batch, artifact inspect, benchmark."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from premia import artifact, benchmark
from premia.config import load_config
from premia.engine import PricingEngine
from premia.errors import AdvisorError, ArtifactError, ConfigError, DomainValidationError, JournalError, ModelSelectionError, ProviderError, SourceError
from premia.operators import evaluate
from premia.provider import resolve
from premia.run import MappingRun
from premia.schema import FIELD_ORDER
from premia.sources.files import audit_rows, read_quotes, read_seed, strict_json, write_csv

# Exit codes.
OK, INPUT, RUN, ARTIFACT, GATES = 0, 2, 3, 4, 5
# Levels of the log.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")

log = logging.getLogger("premia")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="premia")
    top.add_argument("--log-level", choices=LEVELS, default="WARNING")
    areas = top.add_subparsers(dest="area", required=True)

    def command(area: Any, name: str, *options: tuple[str, dict[str, Any]]) -> None:
        own = area.add_parser(name)
        for flag, how in options:
            own.add_argument(flag, **how)

    need, flag = {"required": True}, {"action": "store_true"}
    command(areas.add_parser("config").add_subparsers(dest="command", required=True), "validate", ("--config", need))
    maps = areas.add_parser("map").add_subparsers(dest="command", required=True)
    command(maps, "run", ("--config", need), ("--run-id", {}), ("--seed-data", {}))
    command(maps, "resume", ("--config", need), ("--run-id", need))
    command(areas.add_parser("model").add_subparsers(dest="command", required=True), "evaluate", ("--artifact", need), ("--require-gates", flag))
    predict = areas.add_parser("predict").add_subparsers(dest="command", required=True)
    command(predict, "row", ("--artifact", need), ("--input", need))
    command(predict, "batch", ("--artifact", need), ("--input", need), ("--output", need))
    command(areas.add_parser("artifact").add_subparsers(dest="command", required=True), "inspect", ("--artifact", need))
    command(areas, "benchmark", ("--config", need), ("--output", need), ("--baseline", {"type": float}), ("--hybrid", flag), ("--enforce", flag))
    return top


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> tuple[dict[str, Any], int]:
    engine = PricingEngine.load(args.artifact, spark)
    rows = audit_rows(artifact.dataset(args.artifact, spark)).persist()
    found = engine.predict(rows, "id").withColumnRenamed("premium", "predicted")
    both = rows.join(found, "id")
    judged = engine.parts.config.evaluation
    interval = evaluate.interval_report(both).first().asDict()
    report = {"metrics": evaluate.point_metrics(both).first().asDict(), "slices": [r.asDict() for r in evaluate.slice_report(both).collect()], "interval": interval, "gates": {"coverage": judged.least_coverage <= interval["coverage"] <= judged.most_coverage}}
    return report, GATES if args.require_gates and not all(report["gates"].values()) else OK


def dispatch(args: argparse.Namespace) -> tuple[Any, int]:
    name = f"{args.area} {getattr(args, 'command', '')}".strip()
    if name == "config validate":
        config = load_config(args.config)
        return {"fingerprint": config.fingerprint(), "provider": resolve(config.provider.callable).identity, "splits": config.evaluation.split_counts(), "domain": config.domain().to_dict()}, OK
    if name == "artifact inspect":
        found = artifact.validate(args.artifact)
        return {"metadata": {k: v for k, v in found.metadata.items() if k != "config"}, "conformal": found.conformal, "report": found.report}, OK
    if name == "predict row":
        raw = args.input if args.input.lstrip().startswith("{") else Path(args.input).read_text()
        value = strict_json(raw)
        if not isinstance(value, dict):
            raise SourceError("a row is a JSON object")
        return PricingEngine.load(args.artifact).predict_row(value), OK
    spark = SparkSession.builder.appName("premia").getOrCreate()
    if name in ("map run", "map resume"):
        config = load_config(args.config)
        seed = read_seed(spark, args.seed_data, config.domain()) if getattr(args, "seed_data", None) else None
        result = MappingRun(spark, config, args.run_id).run(resume=name == "map resume", seed_rows=seed)
        return {"run_id": result.run_id, "artifact": str(result.artifact), "gates": result.report["gates"]}, OK
    if name == "model evaluate":
        return _evaluate(spark, args)
    if name == "predict batch":
        rows = read_quotes(spark, args.input)
        found = PricingEngine.load(args.artifact).predict(rows.withColumn("row", F.struct(*FIELD_ORDER)), "row")
        write_csv(found.select("row.*", "premium", "lower", "upper", "model_version", F.to_json("warnings").alias("warnings")), args.output)
        return {"output": args.output}, OK
    if args.hybrid:
        found = benchmark.run_hybrid_benchmark(spark, load_config(args.config), args.output)
        return found, GATES if args.enforce and not found["gates"]["passed"] else OK
    found = benchmark.run_benchmark(spark, load_config(args.config), args.output, baseline_ms=args.baseline)
    return found, GATES if args.enforce and not all(found["gates"].values()) else OK


def run_cli(argv: Sequence[str] | None = None) -> int:
    """The command's exit code; its result goes to standard output as JSON."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    log.setLevel(args.log_level)
    try:
        result, code = dispatch(args)
    except ArtifactError as e:
        log.error("%s", e)
        return ARTIFACT
    except (ConfigError, DomainValidationError, SourceError, OSError) as e:
        log.error("%s", e)
        return INPUT
    except (JournalError, ProviderError, ModelSelectionError, AdvisorError) as e:
        log.error("%s", e)
        return RUN
    print(json.dumps(result, indent=2, sort_keys=True, default=str))
    return code


def main() -> None:
    raise SystemExit(run_cli())
