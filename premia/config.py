"""Run configuration: strict TOML, every rule checked when it is read."""

from __future__ import annotations

import dataclasses
import hashlib
import ipaddress
import json
import math
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from urllib.parse import urlsplit

from premia.errors import ConfigError, DomainValidationError
from premia.schema import NUMERIC, Domain

STRATEGIES = ("random", "lhs", "active", "bayesian", "hybrid")


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def _within(section: Any, ranges: dict[str, tuple[float, float]]) -> None:
    """Raises for a field below the first or above the second number of its range."""
    for name, (low, high) in ranges.items():
        _require(low <= getattr(section, name) <= high, f"{name} must be within {low}..{high}")


@dataclass(frozen=True)
class Acquisition:
    uncertainty: float = 0.10
    residual: float = 0.05
    breakpoint: float = 0.20
    diversity: float = 0.65
    greedy_spread: float = 0.50
    focused_fraction: float = 0.30

    def __post_init__(self) -> None:
        weights = (self.uncertainty, self.residual, self.breakpoint, self.diversity)
        _require(all(math.isfinite(w) and w >= 0 for w in weights) and sum(weights) > 0, "acquisition weights must not be negative, nor all 0")
        _require(0 <= self.greedy_spread <= 1 and 0 < self.focused_fraction <= 1, "acquisition fractions must be within 0..1")


@dataclass(frozen=True)
class Sampling:
    mapping_budget: int = 260
    initial_size: int = 80
    batch_size: int = 20
    pool_size: int = 4000
    seed: int = 42
    strategy: str = "active"
    acquisition: Acquisition = field(default_factory=Acquisition)

    def __post_init__(self) -> None:
        # The least pool and the largest seed.
        _within(self, {"mapping_budget": (1, math.inf), "initial_size": (1, math.inf), "batch_size": (1, math.inf), "pool_size": (10, math.inf), "seed": (0, 2**32 - 1)})
        _require(self.initial_size <= self.mapping_budget, "initial_size must not exceed mapping_budget")
        _require(self.strategy in STRATEGIES, f"strategy must be one of {STRATEGIES}")


@dataclass(frozen=True)
class Evaluation:
    budget: int = 120
    validation_fraction: float = 0.40
    calibration_fraction: float = 0.30
    audit_fraction: float = 0.30
    conformal_coverage: float = 0.90
    least_coverage: float = 0.85
    most_coverage: float = 0.95
    bootstrap: int = 300
    confidence: float = 0.95

    def __post_init__(self) -> None:
        parts = (self.validation_fraction, self.calibration_fraction, self.audit_fraction)
        _require(all(p > 0 for p in parts) and abs(sum(parts) - 1) <= 1e-9, "evaluation fractions must be positive and sum to 1")
        _require(0.5 < self.conformal_coverage < 1 and 0.5 < self.confidence < 1, "coverage and confidence must be above 0.5 and below 1")
        # The least holdout and the most draws.
        _within(self, {"budget": (3, math.inf), "bootstrap": (0, 100_000)})
        _require(0 <= self.least_coverage <= self.most_coverage <= 1, "the coverage gate is inverted")
        _require(min(self.split_counts().values()) >= 1, "every holdout split needs a row")

    def split_counts(self) -> dict[str, int]:
        """Rows of each holdout split: floors, and one more for the largest remainders, ties to the earlier."""
        raw = {"validation": self.budget * self.validation_fraction, "calibration": self.budget * self.calibration_fraction, "audit": self.budget * self.audit_fraction}
        counts = {k: math.floor(v) for k, v in raw.items()}
        for k in sorted(raw, key=lambda k: counts[k] - raw[k])[: self.budget - sum(counts.values())]:
            counts[k] += 1
        return counts


@dataclass(frozen=True)
class EarlyStopping:
    patience: int = 0
    least_batches: int = 3
    least_gain: float = 0.005
    confidence: float = 0.90

    def __post_init__(self) -> None:
        _require(self.patience >= 0 and self.least_batches >= 1 and 0 <= self.least_gain < 1 and 0.5 < self.confidence < 1, "early stopping is out of range")


@dataclass(frozen=True)
class Model:
    search_iterations: int = 4
    boosting: int = 180
    extra_trees: int = 180
    committee: int = 5
    committee_trees: int = 60
    latency_ceiling_ms: float = 25.0
    latency_repetitions: int = 100

    def __post_init__(self) -> None:
        _require(0 < self.latency_ceiling_ms < math.inf, "the latency ceiling must be above 0")
        # The ranges of model sizes.
        ranges = {"search_iterations": (1, 50), "boosting": (20, 2_000), "extra_trees": (20, 5_000), "committee": (2, 30), "committee_trees": (10, 1_000), "latency_repetitions": (5, 10_000)}
        _within(self, ranges)


@dataclass(frozen=True)
class ProviderSettings:
    callable: str | None = None
    retries: int = 2
    first_pause: float = 0.05
    most_pause: float = 1.0

    def __post_init__(self) -> None:
        _require(self.first_pause <= self.most_pause, "provider pauses must ascend")
        # The most retries, and the longest pauses in seconds.
        _within(self, {"retries": (0, 20), "first_pause": (0, 60), "most_pause": (0, 600)})
        _require(self.callable is None or (self.callable.count(":") == 1 and all(self.callable.strip().split(":"))), "a provider is written module:function")


@dataclass(frozen=True)
class Artifact:
    runs: str = "runs"
    artifacts: str = "artifacts"

    def __post_init__(self) -> None:
        for p in (self.runs, self.artifacts):
            _require(bool(p.strip()) and ".." not in Path(p).parts, "paths must not be blank or climb")


@dataclass(frozen=True)
class Advisor:
    """The local model server. A quantization is checked where one is named, memory where most_bytes is above 0."""

    endpoint: str = "http://127.0.0.1:11434"
    model: str = ""
    version: str = ""
    digest: str = ""
    timeout_s: float = 60.0
    quantization: str = ""
    most_bytes: int = 0

    def __post_init__(self) -> None:
        parts = urlsplit(self.endpoint)
        try:
            local = ipaddress.ip_address(parts.hostname or "").is_loopback
        except ValueError:
            local = False
        _require(parts.scheme == "http" and local and not parts.username and parts.path in ("", "/") and not parts.query, "the advisor must be plain HTTP at a literal loopback address")
        _require(not self.digest or (len(self.digest) == 64 and set(self.digest) <= set("0123456789abcdef")), "a digest has 64 hex digits")
        _require(0 < self.timeout_s <= 60, "the advisor answers within 60 s")
        _require(self.most_bytes >= 0, "the advisor's memory must not be negative")


@dataclass(frozen=True)
class Config:
    config_version: int = 1
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    sampling: Sampling = field(default_factory=Sampling)
    evaluation: Evaluation = field(default_factory=Evaluation)
    early_stopping: EarlyStopping = field(default_factory=EarlyStopping)
    model: Model = field(default_factory=Model)
    provider: ProviderSettings = field(default_factory=ProviderSettings)
    artifact: Artifact = field(default_factory=Artifact)
    advisor: Advisor | None = None

    def __post_init__(self) -> None:
        _require(self.config_version == 1, "config_version must be 1")
        _require(set(self.bounds) <= set(NUMERIC), "bounds name numeric fields only")
        _require(self.sampling.strategy != "hybrid" or self.advisor is not None, "the hybrid strategy needs an advisor")
        try:
            self.domain()
        except DomainValidationError as e:
            raise ConfigError(str(e)) from e

    def domain(self) -> Domain:
        return Domain().narrowed(self.bounds)

    def to_dict(self) -> dict[str, Any]:
        return json.loads(json.dumps(dataclasses.asdict(self)))

    def fingerprint(self) -> str:
        """SHA-256 of all settings but the paths."""
        held = self.to_dict()
        held.pop("artifact")
        return hashlib.sha256(json.dumps(held, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


_SECTIONS = {"sampling": Sampling, "evaluation": Evaluation, "early_stopping": EarlyStopping, "model": Model, "provider": ProviderSettings, "artifact": Artifact, "advisor": Advisor, "acquisition": Acquisition}


def _build(kind: type, raw: Any, where: str) -> Any:
    _require(isinstance(raw, dict), f"{where}: not a table")
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(raw) - set(fields):
        raise ConfigError(f"{where}: unknown {sorted(unknown)}")
    values: dict[str, Any] = {}
    for name, value in raw.items():
        if name in _SECTIONS and kind in (Config, Sampling):
            values[name] = None if value is None else _build(_SECTIONS[name], value, name)
            continue
        if name == "bounds":
            _require(isinstance(value, dict) and all(isinstance(v, list) and len(v) == 2 and all(isinstance(x, int | float) and not isinstance(x, bool) for x in v) for v in value.values()), "bounds: pairs of numbers")
            values[name] = {k: tuple(v) for k, v in value.items()}
            continue
        want = {"int": int, "float": (int, float), "str": str, "str | None": (str, type(None))}[str(fields[name].type)]
        _require(isinstance(value, want) and not isinstance(value, bool), f"{where}.{name}: not of its type")
        values[name] = float(value) if str(fields[name].type) == "float" else value
    return kind(**values)


def config_of(raw: dict[str, Any]) -> Config:
    return _build(Config, raw, "config")


def load_config(path: str | Path) -> Config:
    path = Path(path)
    _require(path.suffix == ".toml", "a configuration is a .toml file")
    try:
        return config_of(tomllib.loads(path.read_text()))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e


def config_toml(config: Config) -> str:
    """The configuration as TOML that load_config reads back to an equal one."""
    lines: list[str] = []

    def put(table: dict[str, Any], name: str) -> None:
        plain = {k: v for k, v in table.items() if not isinstance(v, dict) and v is not None}
        if name and plain:
            lines.append(f"\n[{name}]")
        lines.extend(f"{k} = {json.dumps(v)}" for k, v in plain.items())
        for k, v in table.items():
            if isinstance(v, dict):
                put(v, f"{name}.{k}".lstrip("."))

    put(config.to_dict(), "")
    return "\n".join(lines).lstrip() + "\n"
