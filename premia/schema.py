"""The quote row: fields, bounds, levels and the domain that a configuration may narrow."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from premia.errors import DomainValidationError

# Names in their contractual order, outer bounds and closed levels.
FIELD_ORDER = (
    "driver_age", "years_licensed", "vehicle_year", "vehicle_value", "annual_km", "claims_5y", "convictions_5y", "postcode_risk",
    "theft_risk", "excess", "usage", "parking", "hire_car", "windscreen", "rating",
)
OUTER_BOUNDS = {
    "driver_age": (17.0, 90.0),
    "years_licensed": (0, 70),
    "vehicle_year": (1998, 2026),
    "vehicle_value": (2000.0, 200000.0),
    "annual_km": (1000, 60000),
    "claims_5y": (0, 6),
    "convictions_5y": (0, 6),
    "postcode_risk": (0.0, 1.0),
    "theft_risk": (0.0, 1.0),
    "excess": (0, 5000),
}
LEVELS = {
    "usage": ("private", "commute", "business"),
    "parking": ("garage", "driveway", "street"),
    "hire_car": ("none", "basic", "premium"),
    "windscreen": ("no", "yes"),
    "rating": ("market", "agreed"),
}
SPLITS = ("mapping", "validation", "calibration", "audit")
RATING_YEAR = 2026

NUMERIC = tuple(OUTER_BOUNDS)
CONTINUOUS = tuple(n for n, (low, _) in OUTER_BOUNDS.items() if isinstance(low, float))
INTEGER = tuple(n for n in NUMERIC if n not in CONTINUOUS)
CATEGORICAL = tuple(LEVELS)

#: Years between the youngest driver that may hold a licence and the licence.
LICENCE_AGE = 16


def quote_schema(extra: Mapping[str, T.DataType] | None = None) -> T.StructType:
    """The 15 columns, never null, and then `extra`."""
    kinds = {n: T.DoubleType() for n in CONTINUOUS} | {n: T.LongType() for n in INTEGER} | {n: T.StringType() for n in CATEGORICAL}
    fields = [T.StructField(n, kinds[n], False) for n in FIELD_ORDER]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in (extra or {}).items()])


@dataclass(frozen=True)
class Domain:
    """Numeric bounds (inclusive) by field, within the outer ones; levels are closed."""

    numeric: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(OUTER_BOUNDS))
    categorical: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(LEVELS))

    def __post_init__(self) -> None:
        if set(self.numeric) != set(NUMERIC) or set(self.categorical) != set(CATEGORICAL):
            raise DomainValidationError("a domain names each field exactly once")
        for name, (low, high) in self.numeric.items():
            if not (math.isfinite(low) and math.isfinite(high) and low < high):
                raise DomainValidationError(f"{name}: bounds must be finite and ascending")
            if name in INTEGER and (low != int(low) or high != int(high)):
                raise DomainValidationError(f"{name}: bounds must be whole numbers")
            if low < OUTER_BOUNDS[name][0] or high > OUTER_BOUNDS[name][1]:
                raise DomainValidationError(f"{name}: bounds may only narrow {OUTER_BOUNDS[name]}")
        for name, levels in self.categorical.items():
            if not levels or len(set(levels)) != len(levels) or not set(levels) <= set(LEVELS[name]):
                raise DomainValidationError(f"{name}: levels must be distinct and known")
        if max(0, math.floor(self.numeric["driver_age"][1]) - LICENCE_AGE) < self.numeric["years_licensed"][0]:
            raise DomainValidationError("no driver can hold a licence that long")

    def narrowed(self, bounds: Mapping[str, tuple[float, float]]) -> Domain:
        return replace(self, numeric={**self.numeric, **bounds})

    def to_dict(self) -> dict[str, Any]:
        return {
            "schema_version": 1,
            "numeric": {n: {"low": low, "high": high, "integer": n in INTEGER} for n, (low, high) in self.numeric.items()},
            "categorical": {n: list(v) for n, v in self.categorical.items()},
        }

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> Domain:
        if set(raw) != {"schema_version", "numeric", "categorical"} or raw["schema_version"] != 1:
            raise DomainValidationError("not a domain snapshot of version 1")
        numeric = {n: (b["low"], b["high"]) for n, b in raw["numeric"].items()}
        found = cls(numeric, {n: tuple(v) for n, v in raw["categorical"].items()})
        if found.to_dict() != json.loads(json.dumps(raw)):
            raise DomainValidationError("a domain snapshot must not hold anything else")
        return found


def rows_json_schema() -> dict[str, Any]:
    """JSON Schema of one quote row."""
    numbers = {n: {"type": "integer" if n in INTEGER else "number", "minimum": low, "maximum": high} for n, (low, high) in OUTER_BOUNDS.items()}
    names = {n: {"type": "string", "enum": list(v)} for n, v in LEVELS.items()}
    both = numbers | names
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Quote row", "type": "object", "additionalProperties": False, "required": list(FIELD_ORDER), "properties": {n: both[n] for n in FIELD_ORDER}}
