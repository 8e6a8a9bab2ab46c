"""What the files of an artifact must say, each by itself and all of one another."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from premia.advisor import LATENCY_MS, MEMORY_BYTES
from premia.config import Config
from premia.errors import ArtifactError
from premia.models.estimators import Estimator
from premia.operators.acquire import POLICIES
from premia.operators.evaluate import SLICES
from premia.schema import FIELD_ORDER, SPLITS

#: Figures of a report are rounded to four places, so that orders among them hold up to this.
ROUNDED = 1e-3

Check = Callable[[Any], bool]


def number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def amount(x: Any) -> bool:
    return number(x) and x >= 0


def share(x: Any) -> bool:
    return number(x) and 0 <= x <= 1


def count(x: Any) -> bool:
    return type(x) is int and x >= 0


def text(x: Any) -> bool:
    return isinstance(x, str) and bool(x.strip())


def flag(x: Any) -> bool:
    return type(x) is bool


def record(x: Any) -> bool:
    return isinstance(x, dict)


def optional(check: Check) -> Check:
    return lambda x: x is None or check(x)


def each(shape: Any) -> Check:
    return lambda x: isinstance(x, list) and not any(True for item in x for _ in misfits("", item, shape))


def shapes(dependencies: Mapping[str, str], hybrid: bool) -> dict[str, Any]:
    """By file, its keys and the check of each value; a nested mapping is an object with just those keys."""
    errors = {"mae": amount, "rmse": amount, "wape": optional(amount), "r2": optional(number), "p95_error": amount, "max_error": amount}
    bounds = {"lower": amount, "upper": amount}
    report = {
        "latency_ms": amount, "metrics": {"n": count} | errors, "slices": {s: {"n": count} | {k: optional(v) for k, v in errors.items()} for s in SLICES},
        "bootstrap": {"mae": bounds, "rmse": bounds}, "gates": {g: flag for g in ("coverage", "latency", *["advisor"] * hybrid)},
        "interval": {"n": count, "coverage": share, "mean_width": amount, "median_width": amount, "p95_width": amount},
    }
    if hybrid:
        figures = ("total_latency_ms", "maximum_latency_ms", "maximum_resident_bytes")
        passed = {"latency_passed": flag, "memory_passed": flag}
        report["advisor"] = {"decisions": count, "attempts": count, "policies": each(text)} | dict.fromkeys(figures, amount) | passed
    named = dict.fromkeys(("model_version", "kind", "fingerprint"), text)
    return {
        "metadata.json": named | {"artifact_version": count, "spec": record, "warnings": each(text), "revision": optional(text), "rows": dict.fromkeys(SPLITS, count), "config": record},
        "conformal.json": {"coverage": share, "n": count, "rank": count, "radius": amount},
        "evaluation.json": report,
        "selection.json": {"chosen": text, "candidates": each({"name": text, "monotonic": flag, "mae": amount})},
        "provider.json": dict.fromkeys(("attempts", "successes", "retryable", "permanent"), count) | {"latency_ms": amount, "identity": text},
        "dependencies.json": dict.fromkeys(dependencies, text),
    }


def misfits(place: str, value: Any, shape: Any) -> Iterator[str]:
    """Where value isn't of that shape."""
    if not isinstance(shape, Mapping):
        if not shape(value):
            yield place
    elif not isinstance(value, dict) or set(value) != set(shape):
        yield f"{place} (keys)"
    else:
        for key, inner in shape.items():
            yield from misfits(f"{place}: {key}", value[key], inner)


def sound_trees(model: Estimator) -> bool:
    """Whether every tree ends: children come after their parent, fields exist, and numbers are finite."""
    for tree in model.trees:
        columns = (tree.feature, tree.at, tree.levels, tree.left, tree.right, tree.value)
        size = len(tree.value)
        if not size or {len(c) for c in columns} != {size} or not all(map(number, [*tree.at, *tree.value])) or not all(map(count, tree.levels)):
            return False
        for node, (feature, left, right) in enumerate(zip(tree.feature, tree.left, tree.right, strict=True)):
            if type(feature) is not int or not -1 <= feature < len(FIELD_ORDER):
                return False
            if feature >= 0 and not all(type(child) is int and node < child < size for child in (left, right)):
                return False
    return math.isfinite(model.base)


@dataclass(frozen=True)
class Bundle:
    """The JSON files by name, and what was made of them."""

    files: Mapping[str, Any]
    config: Config
    model: Estimator

    def __getattr__(self, name: str) -> Any:
        return self.files[f"{name}.json"]


def _conformal_rank(b: Bundle) -> bool:
    n, coverage = b.metadata["rows"]["calibration"], b.config.evaluation.conformal_coverage
    held = b.conformal
    return held["n"] == n and held["coverage"] == coverage and held["rank"] == min(n, math.ceil((n + 1) * coverage))


def _chosen(b: Bundle) -> bool:
    by_name, spec = {c["name"]: c for c in b.selection["candidates"]}, b.metadata["spec"]
    own = by_name.get(b.selection["chosen"])
    return len(by_name) == len(b.selection["candidates"]) and own is not None and (spec["name"], spec["kind"], spec["monotone"]) == (own["name"], b.model.kind, own["monotonic"])


def _errors(b: Bundle) -> bool:
    m = b.evaluation["metrics"]
    return m["mae"] <= m["rmse"] + ROUNDED and m["rmse"] <= m["max_error"] + ROUNDED and m["p95_error"] <= m["max_error"] + ROUNDED


def _slices(b: Bundle) -> bool:
    most = b.metadata["rows"]["audit"]
    return all(s["n"] <= most and (s["n"] == 0) == (s["mae"] is None) for s in b.evaluation["slices"].values())


def _widths(b: Bundle) -> bool:
    interval, most = b.evaluation["interval"], 2 * b.conformal["radius"] + ROUNDED
    return interval["median_width"] <= interval["p95_width"] + ROUNDED and max(interval["p95_width"], interval["mean_width"]) <= most


def _coverage_gate(b: Bundle) -> bool:
    judged = b.config.evaluation
    return b.evaluation["gates"]["coverage"] == (judged.least_coverage <= b.evaluation["interval"]["coverage"] <= judged.most_coverage)


def _advice(b: Bundle) -> bool:
    held = b.evaluation.get("advisor")
    if held is None:
        return True
    fast, small = held["maximum_latency_ms"] <= LATENCY_MS, held["maximum_resident_bytes"] <= (b.config.advisor.most_bytes or MEMORY_BYTES)
    told = held["decisions"] == len(held["policies"]) <= held["attempts"] and set(held["policies"]) <= set(POLICIES)
    summed = held["total_latency_ms"] >= held["maximum_latency_ms"] - ROUNDED
    return told and summed and (held["latency_passed"], held["memory_passed"], b.evaluation["gates"]["advisor"]) == (fast, small, fast and small)


#: What holds between files, by what is said where it doesn't.
RULES: dict[str, Callable[[Bundle], bool]] = {
    "the model isn't of the kind described": lambda b: b.model.kind == b.metadata["kind"],
    "a tree of the model isn't sound": lambda b: sound_trees(b.model),
    "the conformal state doesn't follow from the configuration": _conformal_rank,
    "the model isn't a candidate that was chosen": _chosen,
    "holdout rows don't follow from the configuration": lambda b: b.metadata["rows"] | {"mapping": 0} == {"mapping": 0} | b.config.evaluation.split_counts(),
    "the report isn't of the audit rows": lambda b: b.evaluation["metrics"]["n"] == b.evaluation["interval"]["n"] == b.metadata["rows"]["audit"],
    "the report's errors contradict one another": _errors,
    "the report's slices contradict the audit rows": _slices,
    "a bootstrap bound is above the other": lambda b: all(x["lower"] <= x["upper"] for x in b.evaluation["bootstrap"].values()),
    "the report's widths don't follow from the radius": _widths,
    "the coverage gate doesn't follow from the coverage": _coverage_gate,
    "the latency gate doesn't follow from the latency": lambda b: b.evaluation["gates"]["latency"] == (b.evaluation["latency_ms"] <= b.config.model.latency_ceiling_ms),
    "the advisor's report contradicts itself": _advice,
    "the provider's attempts aren't the sum of their outcomes": lambda b: b.provider["attempts"] == sum(b.provider[k] for k in ("successes", "retryable", "permanent")),
}


def audit(bundle: Bundle, dependencies: Mapping[str, str]) -> None:
    """Raises ArtifactError at the first value that isn't of its shape or rule that doesn't hold."""
    for name, shape in shapes(dependencies, bundle.config.sampling.strategy == "hybrid").items():
        for place in misfits(name, bundle.files[name], shape):
            raise ArtifactError(f"{place}: missing, unknown or not of its type")
    for message, holds in RULES.items():
        if not holds(bundle):
            raise ArtifactError(message)
