from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from premia.engine import check_row
from premia.errors import DomainValidationError, SourceError
from premia.operators import encode, sample, validate
from premia.operators.tariff import premium
from premia.schema import CONTINUOUS, FIELD_ORDER, OUTER_BOUNDS, Domain, quote_schema, rows_json_schema
from premia.sources.files import quote_rows


def one(spark, row):
    return spark.createDataFrame([tuple(row[n] for n in FIELD_ORDER)], quote_schema())


def test_golden_premium(spark, valid_row):
    assert one(spark, valid_row).select(premium().alias("p")).first().p == 704.65


@pytest.mark.parametrize(
    ("change", "why"),
    [({"driver_age": 16.99}, "driver_age,tenure"), ({"vehicle_value": 200001.0}, "vehicle_value"), ({"postcode_risk": math.nan}, "postcode_risk"), ({"usage": "fleet"}, "usage"), ({"driver_age": 18.0, "years_licensed": 5}, "tenure"), ({"vehicle_year": 2027}, "vehicle_year")],
)
def test_rejects(spark, valid_row, change, why):
    rows = one(spark, valid_row | change)
    assert validate.split_valid(rows)[1].first().reasons == why
    with pytest.raises(DomainValidationError):
        validate.require_valid(rows)
    with pytest.raises(DomainValidationError):
        check_row(valid_row | change, Domain())


def test_bounds_are_inclusive(spark, valid_row):
    assert validate.require_valid(one(spark, valid_row | {"vehicle_year": 2026, "theft_risk": 1.0, "excess": 0})).count() == 1


def test_schema_is_not_coerced(spark, valid_row):
    rows = one(spark, valid_row)
    validate.check_schema(rows)
    for bad in (rows.drop("usage"), rows.withColumn("extra", F.lit(1)), rows.withColumn("excess", F.col("excess").cast("double"))):
        with pytest.raises(DomainValidationError):
            validate.check_schema(bad)


@pytest.mark.parametrize("change", [{"claims_5y": True}, {"claims_5y": 1.0}, {"driver_age": "40"}, {"usage": 3}, {"more": 1}])
def test_row_types(spark, valid_row, change):
    with pytest.raises(SourceError):
        quote_rows(spark, [valid_row | change])


def test_canonicalize(spark, valid_row):
    found = sample.canonicalize(one(spark, valid_row | {"driver_age": 12.0, "years_licensed": 99, "postcode_risk": 3.0})).first()
    assert (found.driver_age, found.years_licensed, found.postcode_risk) == (17.0, 1, 1.0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 40), seed=st.integers(0, 2**32 - 1))
def test_lhs(spark, n, seed):
    rows = sample.lhs_rows(spark, n, seed).toPandas()
    assert len(rows) == n and rows.equals(sample.lhs_rows(spark, n, seed).toPandas())
    for name in CONTINUOUS if n else ():
        low, high = OUTER_BOUNDS[name]
        assert sorted(((rows[name] - low) / (high - low) * n).clip(0, n - 1e-9).astype(int)) == list(range(n))
    assert sample.lhs_rows(spark, n, seed).filter(~validate.row_ok()).count() == 0


def test_generators_refuse(spark):
    for bad in (-1, 1.5, True):
        with pytest.raises(DomainValidationError):
            sample.uniform_rows(spark, bad, 1)


def test_domain_snapshot():
    narrow = Domain().narrowed({"driver_age": (20.0, 60.0)})
    assert Domain.from_dict(narrow.to_dict()) == narrow
    for bad in ({"driver_age": (10.0, 60.0)}, {"excess": (0.5, 10)}, {"driver_age": (60.0, 20.0)}, {"unknown": (0, 1)}):
        with pytest.raises(DomainValidationError):
            Domain().narrowed(bad)
    with pytest.raises(DomainValidationError):
        Domain.from_dict(narrow.to_dict() | {"more": 1})


def test_encodings(spark, valid_row):
    assert len(encode.bin_catalogue()) == 53 and len(encode.feature_names()) == 23 and len(rows_json_schema()["required"]) == 15
    rows = one(spark, valid_row)
    assert rows.select(*encode.ordinal()).first()[-5:] == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert set(rows.select(encode.bin_ids().alias("b")).first().b) <= set(encode.bin_catalogue())
    with pytest.raises(Exception, match="unknown level"):
        one(spark, valid_row | {"usage": "fleet"}).select(*encode.ordinal()).collect()
    a, b = (one(spark, valid_row | {"excess": x}).select(encode.row_key().alias("k")).first().k for x in (700, 701))
    assert a != b
