"""Relational steps of the journal: lookups, upserts, transitions, summaries, history. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.numeric import rounded
from premia.operators.encode import row_key
from premia.operators.validate import row_ok


def number_rows(rows: DataFrame, first: int, *order: str, batch: str = "batch_id") -> DataFrame:
    """rows with ordinal: consecutive from `first` in the order of (batch, *order); each batch is numbered by itself."""
    sizes = rows.groupBy(batch).agg(F.count("*").alias("size"))  # a row for each batch
    before = sizes.select(batch, F.coalesce(F.sum("size").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy(batch).orderBy(*order))
    return rows.withColumn("inner", inner).join(F.broadcast(before), batch).withColumn("ordinal", (F.col("before") + F.col("inner") - 1 + first).cast("long")).drop("inner", "before")


def next_id(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).cast("long").alias("next_id"))


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of each key with the largest version: what repeated upserts leave. Aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c != version]
    held = rows.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("r"))
    return held.select(*key, *(F.col(f"r.{c}").alias(c) for c in [version, *rest]))


def lookup(pending: DataFrame, cache: DataFrame) -> DataFrame:
    """pending (row_key, provider_identity, ...) with the cached premium, null where the provider must be asked."""
    return pending.join(cache.select("provider_identity", "row_key", F.col("premium").alias("cached")), ["provider_identity", "row_key"], "left")


def complete(samples: DataFrame, results: DataFrame) -> DataFrame:
    """samples (id, premium, status) after results (id, premium): filled where pending; a conflict flag where they differ."""
    both = samples.join(results.select("id", F.col("premium").alias("answer")), "id", "left")
    conflict = F.col("premium").isNotNull() & F.col("answer").isNotNull() & (F.col("premium") != F.col("answer"))
    done = F.coalesce("premium", "answer")
    return both.withColumn("conflict", conflict).withColumn("premium", done).withColumn("status", F.when(done.isNull(), "pending").otherwise("complete")).drop("answer")


def batch_states(samples: DataFrame, evaluated: Column) -> DataFrame:
    """batch_id, rows, pending, state: generated while rows are pending, then quoted, then evaluated."""
    counts = samples.filter(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "pending").alias("pending"))
    return counts.withColumn("state", F.when(F.col("pending") > 0, "generated").when(evaluated, "evaluated").otherwise("quoted"))


def provider_summary(attempts: DataFrame) -> DataFrame:
    """One row: attempts, successes, retryable and permanent failures, total latency."""
    outcome = F.col("outcome")
    return attempts.agg(
        F.count("*").alias("attempts"), F.count_if(outcome == "success").alias("successes"), F.count_if(outcome == "retryable_failure").alias("retryable"),
        F.count_if(outcome == "permanent_failure").alias("permanent"), rounded(F.coalesce(F.sum("latency_ms"), F.lit(0.0)), 3).alias("latency_ms"),
    )


def attempts_by_error(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("outcome", F.coalesce("error_type", F.lit("none")).alias("error_type")).agg(F.count("*").alias("n"), rounded(F.sum("latency_ms"), 3).alias("latency_ms"))


def integrity(samples: DataFrame) -> DataFrame:
    """One row of counts that must be 0 (and the holdouts' sizes): what a journal must satisfy before it is resumed."""
    counts = samples.agg(
        F.count("*").alias("rows"), F.count_if(F.col("row_key") != row_key()).alias("altered"), F.count_if(~row_ok()).alias("outside"),
        F.count_if((F.col("status") == "pending") != F.col("premium").isNull()).alias("inconsistent"),
        *(F.count_if(F.col("split") == s).alias(s) for s in ("validation", "calibration", "audit")),
    )
    twice = samples.groupBy("row_key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return counts.crossJoin(F.broadcast(twice))


def mae_trend(history: DataFrame, most: int = 8) -> DataFrame:
    """The last finite MAEs of a history (idx, mae), at six places: idx, mae."""
    fine = history.filter(F.col("mae").isNotNull() & ~F.isnan("mae") & (F.abs("mae") < float("inf")) & (F.col("mae") >= 0))
    return fine.orderBy(F.desc("idx")).limit(most).select("idx", rounded(F.col("mae")).alias("mae"))


def previous_policy(history: DataFrame) -> DataFrame:
    """policy and gain of the last batch with a policy, against the latest earlier MAE; of a history (idx, mae, policy).

    gain is null where either MAE is missing and 0 after an MAE of 0.
    """
    order = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)  # batches of one run
    prior = F.last("mae", ignorenulls=True).over(order)
    gain = F.when(prior == 0, F.lit(0.0)).otherwise((prior - F.col("mae")) / F.nullif(prior, F.lit(0.0)))
    judged = history.withColumn("gain", F.when(F.col("mae").isNotNull() & prior.isNotNull(), rounded(gain)))
    return judged.filter(F.col("policy").isNotNull()).orderBy(F.desc("idx")).limit(1).select("idx", "policy", "gain")


def cumulative_mae(samples: DataFrame) -> DataFrame:
    """batch_id, n, mae over all completed mapping rows up to each batch, from one sum per batch."""
    sums = samples.filter("status = 'complete' AND batch_id IS NOT NULL").groupBy("batch_id").agg(F.count("*").alias("c"), F.sum(F.abs(F.col("premium") - F.col("predicted"))).alias("s"))
    upto = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)  # a row for each batch
    return sums.select("batch_id", F.sum("c").over(upto).alias("n"), rounded(F.sum("s").over(upto) / F.sum("c").over(upto), 4).alias("mae"))
