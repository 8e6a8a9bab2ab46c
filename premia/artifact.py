"""The artifact of a run: a folder that appears whole, with every file's hash, and is checked whenever it is read."""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
import platform
import shutil
import subprocess
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.audit import Bundle, audit
from premia.config import Config, config_of, config_toml, load_config
from premia.errors import ArtifactError, ConfigError, DomainValidationError, LegacyArtifactError, SourceError
from premia.models.estimators import Estimator
from premia.operators.encode import check_metadata, encoder_metadata
from premia.schema import FIELD_ORDER, SPLITS, Domain, rows_json_schema
from premia.sources.files import read_dataset, strict_json, write_csv, write_json

VERSION = 1
FILES = ("dataset.csv", "model.json", "encoder.json", "conformal.json", "evaluation.json", "selection.json", "provider.json", "metadata.json", "dependencies.json", "config.toml", "row-schema.json", "MODEL_CARD.md")


def file_hash(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _revision() -> str | None:
    try:
        found = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, cwd=Path(__file__).parent, check=False)
    except OSError:
        return None
    return found.stdout.strip() or None if found.returncode == 0 else None


def dependencies() -> dict[str, str]:
    return {"python": platform.python_version()} | {n: importlib.metadata.version(n) for n in ("pyspark", "numpy", "pandas", "pyarrow")}


def _cell(value: Any) -> str:
    return ("" if value is None else str(value)).replace("|", "\\|").replace("\n", " ")


def model_card(version: str, kind: str, report: Mapping[str, Any], conformal: Mapping[str, Any], selection: Mapping[str, Any], provider: Mapping[str, Any], warnings: list[str]) -> str:
    """Markdown with fixed sections."""

    def table(head: list[str], rows: list[list[Any]]) -> list[str]:
        return [f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *(f"| {' | '.join(map(_cell, r))} |" for r in rows), ""]

    lines = [f"# Model card: {_cell(version)}", "", "## Model", "", f"Family: {_cell(kind)}. Chosen: {_cell(selection['chosen'])}.", "", "## Intended use", "", "A surrogate of a quote function, for analysis. Its outputs are no underwriting decisions.", "", "## Audit metrics", ""]
    lines += table(["metric", "value"], [[k, v] for k, v in report["metrics"].items()])
    lines += ["## Slices", "", *table(["slice", "rows", "MAE"], [[k, v["n"], v["mae"]] for k, v in report["slices"].items()])]
    lines += ["## Intervals", "", *table(["figure", "value"], [[k, v] for k, v in (dict(conformal) | report["interval"]).items()])]
    lines += ["## Candidates", "", *table(["name", "validation MAE"], [[c["name"], c["mae"]] for c in selection["candidates"]])]
    lines += ["## Provider", "", *table(["figure", "value"], [[k, v] for k, v in provider.items()])]
    lines += ["## Gates", "", *table(["gate", "passed"], [[k, v] for k, v in report["gates"].items()]), "## Warnings", "", *(f"- {_cell(w)}" for w in warnings or ["none"]), ""]
    return "\n".join(lines)


def export(path: Path, *, dataset: DataFrame, model: Estimator, spec: Mapping[str, Any], domain: Domain, config: Config, version: str, conformal: Mapping[str, Any], report: Mapping[str, Any], selection: Mapping[str, Any], provider: Mapping[str, Any], warnings: list[str]) -> Path:
    """Writes all files beside `path`, hashes them, checks the whole, and renames it into place."""
    if path.exists():
        raise ArtifactError(f"{path}: there is an artifact")
    path.parent.mkdir(parents=True, exist_ok=True)
    stage = path.with_name(f".{path.name}-{uuid.uuid4().hex}")
    stage.mkdir()
    try:
        rows = dataset.orderBy("id").select(*FIELD_ORDER, "premium", "split", "source")
        write_csv(rows, stage / "dataset.csv")
        counts = {r["split"]: r["count"] for r in dataset.groupBy("split").count().collect()}
        metadata = {"artifact_version": VERSION, "model_version": version, "kind": model.kind, "spec": dict(spec), "warnings": warnings, "revision": _revision(), "rows": {s: counts.get(s, 0) for s in SPLITS}, "fingerprint": config.fingerprint(), "config": config.to_dict()}
        values = {"model.json": model.to_dict(), "encoder.json": encoder_metadata(domain), "conformal.json": dict(conformal), "evaluation.json": dict(report), "selection.json": dict(selection), "provider.json": dict(provider), "metadata.json": metadata, "dependencies.json": dependencies(), "row-schema.json": rows_json_schema()}
        for name, value in values.items():
            write_json(value, stage / name)
        (stage / "config.toml").write_text(config_toml(config))
        (stage / "MODEL_CARD.md").write_text(model_card(version, model.kind, report, conformal, selection, provider, warnings))
        write_json({"artifact_version": VERSION, "files": {n: file_hash(stage / n) for n in FILES}}, stage / "manifest.json")
        validate(stage, dataset.sparkSession)
        for name in FILES:
            fd = os.open(stage / name, os.O_RDONLY)
            os.fsync(fd)
            os.close(fd)
        os.rename(stage, path)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return path


@dataclass(frozen=True)
class Components:
    model: Estimator
    domain: Domain
    config: Config
    conformal: dict[str, Any]
    metadata: dict[str, Any]
    report: dict[str, Any]


def validate(path: str | Path, spark: SparkSession | None = None) -> Components:
    """Layout, hashes, and whether the files agree; with a session also the dataset. Raises ArtifactError."""
    path = Path(path)
    if path.suffix in (".pkl", ".joblib") or path.is_file() or (path.is_dir() and not (path / "manifest.json").exists()):
        raise LegacyArtifactError(f"{path}: no artifact of this form; make it anew")
    if not path.is_dir():
        raise ArtifactError(f"{path}: no such artifact")
    if (have := {p.name for p in path.iterdir()}) != {*FILES, "manifest.json"}:
        raise ArtifactError(f"files missing or unknown: {sorted(have ^ {*FILES, 'manifest.json'})}")
    if odd := [p.name for p in path.iterdir() if p.is_symlink() or not p.is_file()]:
        raise ArtifactError(f"no regular files: {sorted(odd)}")
    try:
        manifest = strict_json((path / "manifest.json").read_text())
        if set(manifest) != {"artifact_version", "files"} or manifest["artifact_version"] != VERSION or set(manifest["files"]) != set(FILES):
            raise ArtifactError("the manifest isn't of this version")
        if altered := [n for n in FILES if file_hash(path / n) != manifest["files"][n]]:
            raise ArtifactError(f"altered: {', '.join(altered)}")
        held = {n: strict_json((path / n).read_text()) for n in FILES if n.endswith(".json")}
        config, metadata = load_config(path / "config.toml"), held["metadata.json"]
        if metadata["artifact_version"] != VERSION or not config_of(metadata["config"]).fingerprint() == metadata["fingerprint"] == config.fingerprint():
            raise ArtifactError("the configuration isn't the one of the metadata")
        domain = config.domain()
        check_metadata(held["encoder.json"], domain)
        model = Estimator.from_dict(held["model.json"])
        conformal, report = held["conformal.json"], held["evaluation.json"]
        if held["row-schema.json"] != rows_json_schema():
            raise ArtifactError("the row schema isn't the one described")
        audit(Bundle(held, config, model), dependencies())
        if spark is not None:
            read_dataset(spark, f"file://{(path / 'dataset.csv').resolve()}", domain, metadata["rows"])
    except (KeyError, TypeError, AttributeError, SourceError, ConfigError, DomainValidationError) as e:
        raise ArtifactError(f"{path.name}: {e}") from e
    return Components(model, domain, config, conformal, metadata, report)


def dataset(path: str | Path, spark: SparkSession) -> DataFrame:
    found = validate(path)
    return read_dataset(spark, f"file://{(Path(path) / 'dataset.csv').resolve()}", found.domain, found.metadata["rows"]).withColumn("id", F.monotonically_increasing_id())


