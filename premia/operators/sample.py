"""Row generators whose draws depend on (seed, stream, batch, row, field) alone, so that any part can be made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from premia.errors import DomainValidationError
from premia.functions.numeric import clip, uniform
from premia.operators.encode import row_key
from premia.schema import CATEGORICAL, CONTINUOUS, FIELD_ORDER, INTEGER, LICENCE_AGE, Domain

#: Streams of draws.
EVALUATION, MAPPING = 1, 2


def _draw(seed: int, stream: int, batch: int, name: str) -> Column:
    return uniform(seed, stream, batch, name, F.col("i"))


def _rest(seed: int, stream: int, batch: int, domain: Domain) -> dict[str, Column]:
    """Integers and levels, each uniform."""
    found = {}
    for name in INTEGER:
        low, high = (int(x) for x in domain.numeric[name])
        found[name] = F.lit(low).cast("long") + F.floor(_draw(seed, stream, batch, name) * float(high - low + 1))
    for name in CATEGORICAL:
        levels = domain.categorical[name]
        at = F.floor(_draw(seed, stream, batch, name) * float(len(levels)))
        column = F.lit(levels[-1])
        for i, level in reversed(list(enumerate(levels[:-1]))):
            column = F.when(at == i, F.lit(level)).otherwise(column)
        found[name] = column
    return found


def canonicalize(rows: DataFrame, domain: Domain | None = None) -> DataFrame:
    """Generated rows made valid: numbers clipped, integers rounded half to even, tenure lowered to what the age allows."""
    domain = domain or Domain()
    low, high = (int(x) for x in domain.numeric["years_licensed"])
    numbers = {n: clip(F.col(n), *map(float, domain.numeric[n])) for n in CONTINUOUS}
    whole = {n: clip(F.rint(F.col(n).cast("double")), *map(float, domain.numeric[n])).cast("long") for n in INTEGER}
    made = rows.withColumns(numbers | whole)
    most = F.least(F.lit(high).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor("driver_age") - LICENCE_AGE))
    return made.withColumn("years_licensed", F.greatest(F.lit(low).cast("long"), F.least(F.col("years_licensed"), most)))


def uniform_rows(spark: SparkSession, n: int, seed: int, stream: int = MAPPING, batch: int = 0, domain: Domain | None = None) -> DataFrame:
    """i and the 15 columns of n independent uniform rows."""
    domain = _checked(n, domain)
    numbers = {c: F.lit(float(domain.numeric[c][0])) + _draw(seed, stream, batch, c) * float(domain.numeric[c][1] - domain.numeric[c][0]) for c in CONTINUOUS}
    columns = numbers | _rest(seed, stream, batch, domain)
    return canonicalize(spark.range(n).select(F.col("id").alias("i")).select("i", *(columns[c].alias(c) for c in FIELD_ORDER)), domain)


def lhs_rows(spark: SparkSession, n: int, seed: int, stream: int = MAPPING, batch: int = 0, domain: Domain | None = None) -> DataFrame:
    """i and the 15 columns of a Latin hypercube: each continuous field has one row in each of n equal strata.

    A stratum is the row's rank by the hash of (row, field). n is a batch or pool size, which bounds what is ranked.
    """
    domain = _checked(n, domain)
    rows = spark.range(n).select(F.col("id").alias("i"))
    for name in CONTINUOUS:
        joined = F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), F.lit(str(batch)), F.lit(f"{name}-order"), F.col("i").cast("string"))
        rows = rows.withColumn(f"at_{name}", F.row_number().over(Window.orderBy(F.md5(joined), "i")) - 1)
    columns = _rest(seed, stream, batch, domain)
    for name in CONTINUOUS:
        low, high = (float(x) for x in domain.numeric[name])
        point = (F.col(f"at_{name}").cast("double") + _draw(seed, stream, batch, name)) / float(max(n, 1))
        columns[name] = F.lit(low) + point * (high - low)
    return canonicalize(rows.select("i", *(columns[c].alias(c) for c in FIELD_ORDER)), domain)


def _checked(n: int, domain: Domain | None) -> Domain:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise DomainValidationError("the number of rows must be a whole number, 0 or more")
    return domain or Domain()


def unique_rows(candidates: DataFrame, used: DataFrame, n: int) -> DataFrame:
    """The first n candidates (i, ...) whose row_key is not among used (row_key) nor that of an earlier candidate."""
    keyed = candidates.withColumn("row_key", row_key())
    first = F.row_number().over(Window.partitionBy("row_key").orderBy("i"))
    fresh = keyed.join(used.select("row_key"), "row_key", "left_anti").withColumn("nth", first).filter("nth = 1").drop("nth")
    return fresh.orderBy("i").limit(n)
