"""Evaluation: metrics, slices, conformal intervals, bootstrap bounds, normalisation, early stopping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import clip, rounded, uniform

# The risk slices.
SLICES = {
    "young_driver": "driver_age < 25",
    "senior_driver": "driver_age >= 60",
    "claims_history": "claims_5y > 0",
    "high_postcode_risk": "postcode_risk >= 0.70D",
    "high_value_vehicle": "vehicle_value >= 100000",
    "business_use": "usage = 'business'",
    "street_parking": "parking = 'street'",
}


def point_metrics(rows: DataFrame, *keys: str, actual: str = "premium", predicted: str = "predicted") -> DataFrame:
    """By keys: n, mae, rmse, wape and r2 (null without a spread to compare with), p95_error by the higher rule, max_error.

    Groups are few (splits, slices, batches): one row for each is broadcast.
    """
    y, p, e = F.col(actual), F.col(predicted), F.col("e")
    error = rows.select(*keys, y.alias("y"), F.abs(y - p).alias("e"))
    spread = F.var_pop("y") * F.count("*")  # the squares about the mean, merged from partitions without loss
    stats = error.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("e").alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.sum("e") / F.nullif(F.sum(F.abs("y")), F.lit(0.0))).alias("wape"), (F.lit(1.0) - F.sum(e * e) / F.nullif(spread, F.lit(0.0))).alias("r2"),
        F.max("e").alias("max_error"), F.expr("percentile(e, 0.95D)").alias("at"),
    )
    # the second pass finds the least error not below the exact percentile, and carries the rest along
    both = error.select(*keys, "e").join(F.broadcast(stats), list(keys)) if keys else error.select("e").crossJoin(F.broadcast(stats))
    carried = [F.first(c).alias(c) for c in ("n", "mae", "rmse", "wape", "r2", "max_error")]
    found = both.filter(_not_below("e")).groupBy(*keys).agg(F.min("e").alias("p95_error"), *carried)
    places = {"mae": 4, "rmse": 4, "wape": 6, "r2": 6, "p95_error": 4, "max_error": 4}
    return found.select(*keys, F.col("n").cast("long").alias("n"), *(rounded(F.col(c), k).alias(c) for c, k in places.items()))


def _not_below(value: str) -> Column:
    """Whether value isn't below `at`, the exact percentile, which lies between the two elements around q * (n - 1)."""
    return F.col(value) >= F.col("at") - F.abs(F.col("at")) * 1e-12


def quantile_higher(rows: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """keys and value: the element ceil(q * (n - 1)) of the sorted values of each group, exactly, for groups of any size.

    Spark's exact percentile merges partial counts of distinct values; of each group one row is broadcast.
    """
    bound = rows.groupBy(*keys).agg(F.expr(f"percentile(`{value}`, {q!r}D)").alias("at"))
    both = rows.join(F.broadcast(bound), list(keys)) if keys else rows.crossJoin(F.broadcast(bound))
    return both.filter(_not_below(value)).groupBy(*keys).agg(F.min(value).alias("value"))


def nth_smallest(rows: DataFrame, value: str, rank: Callable[[Column], Column]) -> DataFrame:
    """n, rank and value: of n rows with a value of 0 or more, the one of rank(n), from 1, exactly, for any number of rows.

    Rows are counted in narrow buckets of the value's logarithm; only the bucket that holds the rank is looked into, by
    its distinct values. What one task orders are the counts of buckets, at most some 500,000, and those values.
    """
    bucket = F.floor(F.log2(F.greatest(F.col(value), F.lit(1e-300))) * 256).alias("bucket")
    held = rows.select(F.col(value).alias("value"), bucket)
    counts = held.groupBy("bucket").agg(F.count("*").alias("own"))
    upto = F.sum("own").over(Window.orderBy("bucket"))
    placed = counts.select("bucket", (upto - F.col("own")).alias("before"), upto.alias("upto"), F.sum("own").over(Window.partitionBy()).alias("n"))
    placed = placed.withColumn("rank", rank(F.col("n")).cast("long")).filter("before < rank and rank <= upto")
    inside = held.join(F.broadcast(placed), "bucket").groupBy("value").agg(F.count("*").alias("own"), *(F.first(c).alias(c) for c in ("n", "rank", "before")))
    inside = inside.withColumn("upto", F.col("before") + F.sum("own").over(Window.orderBy("value")))
    return inside.filter("rank <= upto").groupBy("n", "rank").agg(F.min("value").alias("value"))


def by_slice(rows: DataFrame) -> DataFrame:
    """rows once for each slice that they are in."""
    inside = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in SLICES.items())))
    return rows.withColumn("slice", F.explode(inside))


def slice_report(rows: DataFrame) -> DataFrame:
    """point_metrics for each risk slice; a slice without rows has n 0 and null metrics."""
    names = rows.sparkSession.createDataFrame([(n,) for n in SLICES], "slice string")
    found = names.join(point_metrics(by_slice(rows), "slice"), "slice", "left")
    return found.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def conformal_radius(rows: DataFrame, coverage: float, actual: str = "premium", predicted: str = "predicted") -> DataFrame:
    """n, conformal_rank, radius: the error of rank min(n, ceil((n + 1) * coverage)) among the sorted ones."""
    errors = rows.select(F.abs(F.col(actual) - F.col(predicted)).alias("e"))
    found = nth_smallest(errors, "e", lambda n: F.least(n, F.ceil((n + 1).cast("double") * F.lit(float(coverage)))))
    return found.select("n", F.col("rank").alias("conformal_rank"), F.col("value").alias("radius"))


def conformal_bounds(rows: DataFrame, radius: Column, predicted: str = "predicted") -> DataFrame:
    return rows.withColumn("lower", F.greatest(F.lit(0.0), F.col(predicted) - radius)).withColumn("upper", F.col(predicted) + radius)


def interval_report(rows: DataFrame, actual: str = "premium") -> DataFrame:
    """n, coverage (bounds included), mean_width, median_width, p95_width (higher)."""
    y, width = F.col(actual), F.col("upper") - F.col("lower")
    inside = ((y >= F.col("lower")) & (y <= F.col("upper"))).cast("double")
    widths = rows.select(width.alias("width"), inside.alias("inside"))
    middle, at = F.median("width").alias("median_width"), F.expr("percentile(width, 0.95D)").alias("at")
    stats = widths.agg(F.count("*").alias("n"), F.avg("inside").alias("coverage"), F.avg("width").alias("mean_width"), middle, at)
    tail = widths.select("width").crossJoin(F.broadcast(stats)).filter(_not_below("width"))
    found = tail.agg(*(F.first(c).alias(c) for c in ("n", "coverage", "mean_width", "median_width")), F.min("width").alias("p95_width"))
    places = {"coverage": 6, "mean_width": 4, "median_width": 4, "p95_width": 4}
    return found.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), *(rounded(F.col(c), k).alias(c) for c, k in places.items()))


def bootstrap(errors: DataFrame, n: int, replicates: int, confidence: float, seed: int) -> DataFrame:
    """metric, estimate, lower, upper of MAE and RMSE by resampling errors (position 0 to n - 1, e) with replacement.

    Draws depend on (seed, replicate, place) alone. The errors of an evaluation split, whose size the configuration
    bounds, are broadcast; replicates are spread over the cluster and summed before the shuffle.
    """
    spark = errors.sparkSession
    draws = spark.range(replicates * n).select(F.expr(f"id div {n}").alias("replicate"), (F.col("id") % n).alias("place"))
    draws = draws.withColumn("position", F.floor(uniform(seed, "boot", F.col("replicate"), F.col("place")) * n))
    sums = draws.join(F.broadcast(errors), "position").groupBy("replicate").agg(F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    tail = (1 - confidence) / 2
    point = errors.agg(F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    limits = sums.agg(*(F.expr(f"percentile({m}, array({tail!r}D, {1 - tail!r}D))").alias(m) for m in ("mae", "rmse")))
    both = point.crossJoin(limits.select(F.col("mae").alias("mae_ci"), F.col("rmse").alias("rmse_ci")))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate"), F.col(f"{m}_ci")[0].alias("lower"), F.col(f"{m}_ci")[1].alias("upper")) for m in ("mae", "rmse"))))
    return both.select(rows.alias("r")).select("r.metric", *(rounded(F.col(f"r.{c}"), 4).alias(c) for c in ("estimate", "lower", "upper")))


def normalized(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns scaled to 0..1 over all rows; a constant one becomes 0. Only one row of bounds is broadcast."""
    bounds = rows.agg(*(f(c).alias(f"__{f.__name__}_{c}") for c in columns for f in (F.min, F.max)))
    both = rows.crossJoin(F.broadcast(bounds))
    span = {c: F.col(f"__max_{c}") - F.col(f"__min_{c}") for c in columns}
    scaled = {c: F.when(span[c] > 0, clip((F.col(c) - F.col(f"__min_{c}")) / span[c], 0.0, 1.0)).otherwise(F.lit(0.0)) for c in columns}
    return both.withColumns(scaled).select(*rows.columns)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """q0, q10, q50, q90 and q100 of a column scaled to 0..1, at six places."""
    qs = (0.0, 0.1, 0.5, 0.9, 1.0)
    held = normalized(rows.select(column), column).agg(F.expr(f"percentile({column}, array({', '.join(f'{q!r}D' for q in qs)}))").alias("q"))
    return held.select(*(rounded(F.col("q")[i]).alias(f"q{round(q * 100)}") for i, q in enumerate(qs)))


def early_stop(batches: DataFrame, patience: int, least_batches: int, least_gain: float) -> DataFrame:
    """The fold over a history (idx, mae, lower, upper): batches, best_mae, stale, should_stop.

    A batch improves iff its upper bound is below the best lower bound times 1 - least_gain; without a best, it does.
    """
    state = "named_struct('batches', 0L, 'best_mae', CAST(NULL AS DOUBLE), 'best_lower', CAST(NULL AS DOUBLE), 'stale', 0L, 'stopped', false)"
    better = f"(acc.best_lower IS NULL OR x.upper < acc.best_lower * (1D - {least_gain!r}D))"
    stale = f"IF({better}, 0L, acc.stale + 1L)"
    stop = f"({patience} > 0 AND acc.batches + 1 >= {least_batches} AND {stale} >= {patience})"
    step = f"named_struct('batches', acc.batches + 1L, 'best_mae', IF({better}, x.mae, acc.best_mae), 'best_lower', IF({better}, x.lower, acc.best_lower), 'stale', {stale}, 'stopped', {stop})"
    held = batches.agg(F.array_sort(F.collect_list(F.struct("idx", "mae", "lower", "upper"))).alias("h"))
    folded = held.select(F.expr(f"aggregate(h, {state}, (acc, x) -> {step})").alias("s"))
    return folded.select("s.batches", rounded(F.col("s.best_mae")).alias("best_mae"), "s.stale", F.col("s.stopped").alias("should_stop"))
