"""Predicates on rows: bounds, levels, tenure, targets, predictions. Rows are rejected, never clipped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.errors import DomainValidationError
from premia.functions.numeric import finite
from premia.schema import CATEGORICAL, FIELD_ORDER, INTEGER, LICENCE_AGE, Domain, quote_schema


def max_tenure() -> Column:
    """Years that a driver of that age may have held a licence."""
    return F.greatest(F.lit(0).cast("long"), F.floor("driver_age") - LICENCE_AGE)


def tenure_ok() -> Column:
    return F.col("years_licensed") <= max_tenure()


def field_ok(name: str, domain: Domain | None = None) -> Column:
    """Whether a field is within the domain: bounds, whole numbers, levels. False for null and NaN."""
    domain = domain or Domain()
    if name in CATEGORICAL:
        return F.coalesce(F.col(name).isin(*domain.categorical[name]), F.lit(False))
    low, high = domain.numeric[name]
    found = finite(F.col(name).cast("double")) & F.col(name).between(low, high)
    return F.coalesce(found & (F.col(name) == F.floor(F.col(name))) if name in INTEGER else found, F.lit(False))


def row_ok(domain: Domain | None = None) -> Column:
    return reduce(lambda a, b: a & b, [field_ok(n, domain) for n in FIELD_ORDER]) & F.coalesce(tenure_ok(), F.lit(False))


def reject_reasons(domain: Domain | None = None) -> Column:
    """The fields that break a rule, in their order, then `tenure`, joined by commas."""
    parts = [F.when(~field_ok(n, domain), n) for n in FIELD_ORDER]
    return F.concat_ws(",", *parts, F.when(~F.coalesce(tenure_ok(), F.lit(False)), "tenure"))


def check_schema(df: DataFrame, extra: dict[str, T.DataType] | None = None) -> None:
    """Raises unless df has exactly the quote columns (and extra) in their types; nothing is coerced."""
    want = {f.name: f.dataType for f in quote_schema(extra).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    if want != have:
        wrong = sorted(n for n in want.keys() | have.keys() if want.get(n) != have.get(n))
        raise DomainValidationError(f"columns missing, unknown or of another type: {', '.join(wrong)}")


def split_valid(df: DataFrame, domain: Domain | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their reasons)."""
    judged = df.withColumn("reasons", reject_reasons(domain))
    return judged.filter(F.col("reasons") == "").drop("reasons"), judged.filter(F.col("reasons") != "")


def require_valid(df: DataFrame, domain: Domain | None = None) -> DataFrame:
    """df, or an error that names a rejected row's fields."""
    if bad := split_valid(df, domain)[1].select("reasons").head():
        raise DomainValidationError(f"row rejected: {bad.reasons}")
    return df


def target_ok(value: Column) -> Column:
    """Whether a premium is finite and not negative."""
    return finite(value) & (value >= 0)


def prediction_ok() -> Column:
    """0 <= lower <= premium <= upper and a version that isn't blank."""
    ordered = (F.col("lower") >= 0) & (F.col("lower") <= F.col("premium")) & (F.col("premium") <= F.col("upper"))
    return F.coalesce(ordered & finite(F.col("upper")) & (F.trim("model_version") != ""), F.lit(False))


#: Fixed value: what a run may be called.
RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def run_id_ok(name: Column) -> Column:
    return F.coalesce(name.rlike(RUN_ID), F.lit(False))


def parse_number(raw: Column, whole: bool) -> Column:
    """A CSV cell as a number: finite, and without a fraction if whole ('12.0' is 12); null for anything else."""
    number = raw.try_cast("double")
    kept = F.when(finite(number), number)
    return F.when(kept == F.floor(kept), kept).cast("long") if whole else kept



