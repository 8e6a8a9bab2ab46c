"""The reference tariff as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from premia.functions.numeric import rounded
from premia.schema import RATING_YEAR

# Fixed values of the tariff.
BASE, VALUE_RATE, POSTCODE_RATE = 300.0, 0.0105, 0.62
AGE_FACTORS = ((21.0, 1.95), (25.0, 1.52), (35.0, 1.18))
SENIOR_AGE, SENIOR_FACTOR = 60.0, 1.10
PARKING = {"garage": 0.92, "driveway": 1.00, "street": 1.13}
USAGE = {"private": 0.98, "commute": 1.00, "business": 1.13}
HIRE_CAR = {"none": 1.00, "basic": 1.04, "premium": 1.08}
WINDSCREEN = {"no": 1.0, "yes": 1.02}
RATING = {"market": 1.0, "agreed": 1.015}
FLOOR = 260.0


def _factor(name: str, factors: dict[str, float]) -> Column:
    found = F.lit(None).cast("double")
    for level, value in factors.items():
        found = F.when(F.col(name) == level, F.lit(value)).otherwise(found)
    return found


def unrounded_premium() -> Column:
    """The premium before its floor and rounding; the factors multiply from left to right."""
    age, claims = F.col("driver_age"), F.col("claims_5y").cast("double")
    postcode = F.col("postcode_risk")
    vehicle_age = F.greatest(F.lit(0).cast("long"), F.lit(RATING_YEAR).cast("long") - F.col("vehicle_year"))
    bands = F.when(age >= SENIOR_AGE, F.lit(SENIOR_FACTOR)).otherwise(F.lit(1.0))
    for below, value in reversed(AGE_FACTORS):
        bands = F.when(age < below, F.lit(value)).otherwise(bands)
    claimed = F.when(F.col("claims_5y") > 0, F.lit(0.10) * postcode).otherwise(F.lit(0.10) * postcode * 0.0)
    factors = [
        F.lit(1.0) + F.lit(POSTCODE_RATE) * postcode,
        F.lit(1.0) + F.lit(0.010) * F.least(vehicle_age, F.lit(10).cast("long")) + F.lit(0.020) * F.greatest(F.lit(0).cast("long"), vehicle_age - 10),
        bands,
        F.lit(1.0) - F.lit(0.06) * F.tanh((F.col("years_licensed") - 3) / 6.0),
        (F.lit(1.0) + F.lit(0.22) * claims + F.lit(0.28) * F.col("convictions_5y")) * (F.lit(1.0) + claimed),
        (F.lit(1.0) + F.lit(0.55) * F.col("theft_risk")) * _factor("parking", PARKING),
        _factor("usage", USAGE),
        F.lit(1.0) + F.lit(0.11) * F.tanh((F.col("annual_km") - 12000) / 12000.0),
        _factor("hire_car", HIRE_CAR),
        _factor("windscreen", WINDSCREEN),
        _factor("rating", RATING),
        F.lit(1.0) - F.lit(0.16) * F.tanh((F.col("excess") - 600) / 700.0),
    ]
    found = F.lit(BASE) + F.lit(VALUE_RATE) * F.col("vehicle_value")
    for factor in factors:
        found = found * factor
    return found


def premium() -> Column:
    """The premium of a row with the 15 columns: at least FLOOR, two places; null for an unknown level."""
    raw = unrounded_premium()
    return F.when(raw.isNotNull(), rounded(F.greatest(raw, F.lit(FLOOR)), 2))
