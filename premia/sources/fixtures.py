"""Quote rows derived from the star schema, and what a run would make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from premia.functions.numeric import clip, rounded
from premia.operators.tariff import premium
from premia.schema import FIELD_ORDER

#: Default evaluation and mapping budgets, and mapping rows a batch.
VALIDATION, CALIBRATION, AUDIT, MAPPING, BATCH = 48, 36, 36, 260, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote per order: quote_id and the 15 columns."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    age = F.lit(17.0) + ((c * 7 + k * 13) % 7301).cast("double") / 100.0
    priority = F.substring("o_orderpriority", 1, 1)
    columns = {
        "driver_age": age,
        "years_licensed": F.least((k * 3 + c) % 71, F.greatest(F.lit(0).cast("long"), F.floor(age) - 16)),
        "vehicle_year": F.lit(1998).cast("long") + k % 29,
        "vehicle_value": clip(F.col("o_totalprice").cast("double") * 0.4, 2000.0, 200000.0),
        "annual_km": F.lit(1000).cast("long") + (k * 37 + c * 11) % 59001,
        "claims_5y": (c + k) % 7,
        "convictions_5y": (c * 5 + k) % 7,
        "postcode_risk": ((F.col("c_nationkey").cast("long") * 37 + c) % 1001).cast("double") / 1000.0,
        "theft_risk": ((k * 17) % 1001).cast("double") / 1000.0,
        "excess": (k * 53 + c * 3) % 5001,
        "usage": F.when(F.col("c_mktsegment") == "HOUSEHOLD", "private").when(F.col("c_mktsegment").isin("AUTOMOBILE", "FURNITURE"), "commute").otherwise("business"),
        "parking": F.when(F.col("o_orderstatus") == "F", "garage").when(F.col("o_orderstatus") == "O", "driveway").otherwise("street"),
        "hire_car": F.when(priority.isin("1", "2"), "premium").when(priority == "3", "basic").otherwise("none"),
        "windscreen": F.when(k % 2 == 0, "yes").otherwise("no"),
        "rating": F.when(c % 3 == 0, "agreed").otherwise("market"),
    }
    return both.select(k.alias("quote_id"), *(columns[n].alias(n) for n in FIELD_ORDER))


def invalid_rows(quotes: DataFrame) -> DataFrame:
    """The quotes with one in 97 of them broken in each of five ways."""
    way = F.col("quote_id") % 97
    return quotes.withColumns({
        "years_licensed": F.when(way == 4, F.floor("driver_age") - 15).otherwise(F.col("years_licensed")),
        "driver_age": F.when(way == 1, F.lit(16.99)).otherwise(F.col("driver_age")),
        "vehicle_value": F.when(way == 2, F.lit(200001.0)).otherwise(F.col("vehicle_value")),
        "postcode_risk": F.when(way == 3, F.lit(float("nan"))).otherwise(F.col("postcode_risk")),
        "usage": F.when(way == 5, F.lit("fleet")).otherwise(F.col("usage")),
    })


def predicted(premium_: Column | str = "premium", factor: int = 29) -> Column:
    """What a fixed predictor says: the premium times a factor between 0.9 and 1.1 that its id names."""
    premium_ = F.col(premium_) if isinstance(premium_, str) else premium_
    return premium_ * (F.lit(0.9) + ((F.col("quote_id") * factor) % 201).cast("double") / 1000.0)


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quotes_view with premium and predicted."""
    return quotes_view(spark, sf_dir).withColumn("premium", premium()).withColumn("predicted", predicted())


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rk, their place in the order of a hash of the id, and n, their number.

    A global order needs one sequence: the hashes are split into 4096 ranges, rows are counted by range, and a
    row's place is its place in the range after all rows of the ranges before. No task sorts more than a range.
    """
    key = F.md5(F.concat(F.lit("42:split:"), F.col("quote_id").cast("string")))
    keyed = rows.withColumn("split_key", key).withColumn("split_range", F.conv(F.substring("split_key", 1, 3), 16, 10).cast("int"))
    counts = keyed.groupBy("split_range").agg(F.count("*").alias("in_range"))
    order = Window.orderBy("split_range")
    before = counts.select("split_range", F.coalesce(F.sum("in_range").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("in_range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    inner = F.row_number().over(Window.partitionBy("split_range").orderBy("split_key", "quote_id"))
    placed = keyed.withColumn("in_order", inner).join(F.broadcast(before), "split_range")  # 4096 rows at most
    return placed.withColumn("rk", F.col("before") + F.col("in_order")).drop("split_key", "split_range", "in_order", "before")


def split_rows(rows: DataFrame) -> DataFrame:
    """ranked rows with split: shares of the default budgets, taken from the front of the order."""
    total = float(VALIDATION + CALIBRATION + AUDIT + MAPPING)
    bounds = [("validation", VALIDATION), ("calibration", VALIDATION + CALIBRATION), ("audit", VALIDATION + CALIBRATION + AUDIT)]
    split = F.lit("mapping")
    for name, upto in reversed(bounds):
        split = F.when(F.col("rk") <= F.floor(F.lit(float(upto)) * F.col("n") / total), name).otherwise(split)
    return ranked(rows).withColumn("split", split)


def run_rows(rows: DataFrame) -> DataFrame:
    """ranked rows with role: the default budgets in rows; what is beyond them is the candidate pool."""
    role = F.lit("pool")
    for name, upto in (("mapping", VALIDATION + CALIBRATION + AUDIT + MAPPING), ("audit", VALIDATION + CALIBRATION + AUDIT), ("calibration", VALIDATION + CALIBRATION), ("validation", VALIDATION)):
        role = F.when(F.col("rk") <= upto, name).otherwise(role)
    return ranked(rows).withColumn("role", role)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider attempts from events: provider, outcome, error_type, latency_ms, occurred_at."""
    events = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    outcome = F.when(~failed, "success").when(F.col("value") < 50, "retryable_failure").otherwise("permanent_failure")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider_identity"),
        outcome.alias("outcome"),
        F.when(failed & (F.col("value") < 50), "ProviderUnavailable").when(failed, "ProviderRejected").alias("error_type"),
        F.col("value").cast("double").alias("latency_ms"),
        F.col("ts").alias("occurred_at"),
    )


__all__ = ["attempts", "invalid_rows", "predicted", "priced", "quotes_view", "ranked", "rounded", "run_rows", "split_rows", "table"]
