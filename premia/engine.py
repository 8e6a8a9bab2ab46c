"""Serving: an artifact's model over rows of a DataFrame, or over single rows on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.artifact import Components, validate
from premia.errors import ArtifactError, DomainValidationError
from premia.models.search import score
from premia.operators.evaluate import conformal_bounds
from premia.operators.validate import require_valid
from premia.schema import CATEGORICAL, FIELD_ORDER, INTEGER, LICENCE_AGE, Domain


@dataclass(frozen=True)
class Prediction:
    """A premium and its interval."""

    premium: float
    lower: float
    upper: float
    model_version: str
    warnings: tuple[str, ...] = ()


class PricingEngine:
    """An artifact's model; radius and version must be sound."""

    def __init__(self, components: Components) -> None:
        self.parts = components
        self.radius, self.version = float(components.conformal["radius"]), str(components.metadata["model_version"])
        self.warnings = list(components.metadata["warnings"])
        if not math.isfinite(self.radius) or self.radius < 0 or not self.version.strip():
            raise ArtifactError("the interval's radius must be finite and not negative, and the model must have a version")

    @classmethod
    def load(cls, path: str | Path, spark: SparkSession | None = None) -> PricingEngine:
        return cls(validate(path, spark))

    def predict(self, rows: DataFrame, key: str = "quote_id", strict: bool = True) -> DataFrame:
        """key, premium, lower, upper, model_version, warnings. One stage, no shuffle; an invalid row stops it if strict."""
        valid = require_valid(rows, self.parts.domain) if strict else rows
        bounded = conformal_bounds(score(valid, self.parts.model, key), F.lit(self.radius))
        return bounded.select(key, F.col("predicted").alias("premium"), "lower", "upper", F.lit(self.version).alias("model_version"), F.array(*map(F.lit, self.warnings)).cast("array<string>").alias("warnings"))

    def predict_row(self, row: Mapping[str, Any]) -> dict[str, Any]:
        """One row on the driver, with the same rules."""
        check_row(row, self.parts.domain)
        codes = [self.parts.domain.categorical[n].index(row[n]) if n in CATEGORICAL else float(row[n]) for n in FIELD_ORDER]
        premium = self.parts.model.predict_one(codes)
        return {"premium": premium, "lower": max(0.0, premium - self.radius), "upper": premium + self.radius, "model_version": self.version, "warnings": self.warnings}

    def predict_batch(self, rows: Sequence[Mapping[str, Any]]) -> list[Prediction]:
        """Rows on the driver, in their order; any invalid row stops all. Tables go through predict()."""
        return [Prediction(**{**self.predict_row(row), "warnings": tuple(self.warnings)}) for row in rows]

    def predict_premiums(self, rows: Sequence[Mapping[str, Any]]) -> np.ndarray:
        """The premiums of predict_batch alone."""
        return np.array([p.premium for p in self.predict_batch(rows)], float)

    def info(self) -> dict[str, Any]:
        return {"model_version": self.version, "kind": self.parts.model.kind, "conformal": self.parts.conformal, "warnings": self.warnings, "fields": list(FIELD_ORDER)}


def check_row(row: Mapping[str, Any], domain: Domain) -> None:
    if set(row) != set(FIELD_ORDER):
        raise DomainValidationError(f"fields missing or unknown: {sorted(set(row) ^ set(FIELD_ORDER))}")
    for name in FIELD_ORDER:
        value = row[name]
        if name in CATEGORICAL:
            if value not in domain.categorical[name]:
                raise DomainValidationError(f"{name}: unknown level")
            continue
        if isinstance(value, bool) or not isinstance(value, int if name in INTEGER else (int, float)) or not domain.numeric[name][0] <= value <= domain.numeric[name][1]:
            raise DomainValidationError(f"{name}: outside the domain or not of its type")
    if row["years_licensed"] > max(0, int(row["driver_age"]) - LICENCE_AGE):
        raise DomainValidationError("years_licensed: longer than the age allows")
