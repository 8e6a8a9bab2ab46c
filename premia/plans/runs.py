"""Queries on what a run leaves behind: its journal, attempts, batches, candidates and benchmark records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from premia.functions.numeric import rounded
from premia.operators import encode, evaluate, journal
from premia.plans import sql
from premia.plans.catalogue import query
from premia.plans.sql import r
from premia.schema import FIELD_ORDER
from premia.sources import fixtures as fx


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's journal: its rows by rank, mapping rows in batches of 20, the pool pending."""
    rows = fx.run_rows(fx.priced(spark, sf_dir))
    batch = F.when(F.col("role") == "mapping", F.floor((F.col("rk") - 121) / fx.BATCH)).cast("long")
    return rows.withColumn("batch_id", batch).withColumn("status", F.when(F.col("role") == "pool", "pending").otherwise("complete")).withColumn("row_key", encode.row_key())


@query(f"WITH {sql.JOURNAL} SELECT quote_id, batch_id, premium FROM journal WHERE role = 'mapping' AND status = 'complete' AND batch_id <= 3")
def journal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).filter("role = 'mapping' AND status = 'complete' AND batch_id <= 3").select("quote_id", "batch_id", "premium")


@query(f"WITH {sql.JOURNAL} SELECT role, count(*) AS n, min(quote_id) AS least, max(quote_id) AS most FROM journal WHERE status = 'pending' AND role IN ('pool', 'mapping') GROUP BY role")
def pending_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).filter(F.col("status") == "pending").filter(F.col("role").isin("pool", "mapping"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.min("quote_id").alias("least"), F.max("quote_id").alias("most"))


@query(f"WITH {sql.JOURNAL} SELECT quote_id, {sql.FIELDS}, premium FROM journal WHERE role = 'audit'")
def audit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).filter("role = 'audit'").select("quote_id", *FIELD_ORDER, "premium")


@query(f"WITH {sql.JOURNAL} SELECT quote_id, role, premium FROM journal WHERE rk = 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).filter("rk = 1").select("quote_id", "role", "premium")


@query(f"WITH {sql.JOURNAL} SELECT quote_id, {sql.FIELDS}, premium, role AS split, CASE WHEN batch_id IS NULL THEN 'holdout' ELSE 'batch-' || batch_id END AS source FROM journal WHERE status = 'complete'")
def dataset_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("batch_id").isNull(), "holdout").otherwise(F.concat(F.lit("batch-"), F.col("batch_id")))
    return samples(spark, sf_dir).filter("status = 'complete'").select("quote_id", *FIELD_ORDER, "premium", F.col("role").alias("split"), source.alias("source"))


@query(f"""WITH {sql.JOURNAL}, s AS (SELECT *, {sql.ROW_KEY} AS row_key FROM journal WHERE status = 'complete') SELECT count(*) AS rows, count(*) FILTER (WHERE role = 'mapping') AS mapping, count(*) FILTER (WHERE role = 'audit') AS audit,
    count(*) - count(DISTINCT row_key) AS repeated, count(*) FILTER (WHERE premium < 0 OR NOT isfinite(premium)) AS bad_premiums FROM s""")
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).filter("status = 'complete'")
    by_key = rows.groupBy("row_key").agg(F.count("*").alias("n"), *(F.count_if(F.col("role") == s).alias(s) for s in ("mapping", "audit")), F.count_if((F.col("premium") < 0) | F.isnan("premium") | (F.abs("premium") == float("inf"))).alias("bad"))
    return by_key.agg(F.sum("n").alias("rows"), F.sum("mapping").alias("mapping"), F.sum("audit").alias("audit"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("bad").alias("bad_premiums"))


_CACHE = f"c AS (SELECT {sql.ROW_KEY} AS row_key, 'p' || (quote_id % 3) AS provider_identity, premium AS cached FROM priced WHERE claims_5y <= 2)"


@query(f"WITH {sql.PRICED}, {_CACHE}, p AS (SELECT quote_id, {sql.ROW_KEY} AS row_key, CASE WHEN quote_id % 5 = 0 THEN 'p9' ELSE 'p' || (quote_id % 3) END AS provider_identity FROM priced) SELECT quote_id, cached, cached IS NOT NULL AS hit FROM p LEFT JOIN c USING (row_key, provider_identity)")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.priced(spark, sf_dir).withColumn("row_key", encode.row_key())
    own = F.concat(F.lit("p"), (F.col("quote_id") % 3).cast("string"))
    cache = rows.filter("claims_5y <= 2").withColumn("provider_identity", own)
    pending = rows.withColumn("provider_identity", F.when(F.col("quote_id") % 5 == 0, "p9").otherwise(own)).select("quote_id", "row_key", "provider_identity")
    return journal.lookup(pending, cache).select("quote_id", "cached", F.col("cached").isNotNull().alias("hit"))


@query(f"""WITH {sql.PRICED}, s AS (SELECT quote_id AS id, CASE WHEN quote_id % 2 = 0 THEN premium END AS premium FROM priced), a AS (SELECT quote_id AS id, CASE WHEN quote_id % 14 = 0 THEN premium + 1 ELSE premium END AS answer FROM priced WHERE quote_id % 3 <> 1),
    b AS (SELECT id, coalesce(premium, answer) AS done, coalesce(premium <> answer, false) AS conflict FROM s LEFT JOIN a USING (id)) SELECT id, done AS premium, CASE WHEN done IS NULL THEN 'pending' ELSE 'complete' END AS status, conflict FROM b""")
def complete_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.priced(spark, sf_dir)
    before = rows.select(F.col("quote_id").alias("id"), F.when(F.col("quote_id") % 2 == 0, F.col("premium")).alias("premium"), F.lit("pending").alias("status"))
    answers = rows.filter("quote_id % 3 <> 1").select(F.col("quote_id").alias("id"), F.when(F.col("quote_id") % 14 == 0, F.col("premium") + 1).otherwise(F.col("premium")).alias("premium"))
    return journal.complete(before, answers).select("id", "premium", "status", "conflict")


@query(f"WITH {sql.ATTEMPTS} SELECT count(*) AS attempts, count(*) FILTER (WHERE outcome = 'success') AS successes, count(*) FILTER (WHERE outcome = 'retryable_failure') AS retryable, count(*) FILTER (WHERE outcome = 'permanent_failure') AS permanent, {r('coalesce(sum(latency_ms), 0)', 3)} AS latency_ms FROM attempts")
def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.provider_summary(fx.attempts(spark, sf_dir))


@query(f"WITH {sql.ATTEMPTS} SELECT outcome, coalesce(error_type, 'none') AS error_type, count(*) AS n, {r('sum(latency_ms)', 3)} AS latency_ms FROM attempts GROUP BY 1, 2")
def attempts_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.attempts_by_error(fx.attempts(spark, sf_dir))


@query(f"WITH {sql.ATTEMPTS} SELECT provider_identity, id, row_number() OVER (PARTITION BY provider_identity ORDER BY occurred_at DESC, id DESC) AS recency FROM attempts QUALIFY row_number() OVER (PARTITION BY provider_identity ORDER BY occurred_at DESC, id DESC) <= 5")
def recent_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("provider_identity").orderBy(F.desc("occurred_at"), F.desc("id"))
    return fx.attempts(spark, sf_dir).withColumn("recency", F.row_number().over(order)).filter("recency <= 5").select("provider_identity", "id", F.col("recency").cast("long").alias("recency"))


_HALF = "CASE WHEN role = 'mapping' AND batch_id >= 10 AND quote_id % 2 = 0 THEN 'pending' ELSE status END"


@query(f"WITH {sql.JOURNAL}, h AS (SELECT batch_id, {_HALF} AS status FROM journal WHERE batch_id IS NOT NULL) SELECT batch_id, count(*) AS rows, count(*) FILTER (WHERE status = 'pending') AS pending, CASE WHEN count(*) FILTER (WHERE status = 'pending') > 0 THEN 'generated' WHEN batch_id < 5 THEN 'evaluated' ELSE 'quoted' END AS state FROM h GROUP BY batch_id")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(F.expr("role = 'mapping' AND batch_id >= 10 AND quote_id % 2 = 0"), "pending").otherwise(F.col("status"))
    return journal.batch_states(samples(spark, sf_dir).withColumn("status", half), F.col("batch_id") < 5)


@query(f"WITH {sql.JOURNAL} SELECT quote_id, batch_id, 120 + row_number() OVER (ORDER BY batch_id, rk) - 1 AS ordinal FROM journal WHERE role = 'mapping'")
def ordinal_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.number_rows(samples(spark, sf_dir).filter("role = 'mapping'"), 120, "rk").select("quote_id", "batch_id", "ordinal")


@query(f"WITH {sql.JOURNAL} SELECT coalesce(max(batch_id), -1) + 1 AS next_id FROM journal")
def next_batch_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.next_id(samples(spark, sf_dir), "batch_id")


@query("SELECT user_id AS key, event_id AS version, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.latest(fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), "value"), ["key"], "version")


@query(f"WITH {sql.JOURNAL}, u AS (SELECT premium FROM journal WHERE role = 'mapping' UNION ALL SELECT premium FROM journal WHERE role = 'validation') SELECT count(*) AS n, {r('avg(premium)', 4)} AS mean_premium FROM u")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    both = rows.filter("role = 'mapping'").select("premium").unionByName(rows.filter("role = 'validation'").select("premium"))
    return both.agg(F.count("*").alias("n"), rounded(F.avg("premium"), 4).alias("mean_premium"))


@query(f"""WITH {sql.JOURNAL}, s AS (SELECT *, {sql.ROW_KEY} AS row_key FROM journal), t AS (SELECT * REPLACE (CASE WHEN quote_id % 101 = 0 THEN 'x' ELSE row_key END AS row_key, CASE WHEN quote_id % 89 = 0 THEN NULL WHEN role = 'pool' THEN NULL ELSE premium END AS premium) FROM s)
    SELECT count(*) AS rows, count(*) FILTER (WHERE row_key <> {sql.ROW_KEY}) AS altered, count(*) FILTER (WHERE {sql.REASONS} <> '') AS outside, count(*) FILTER (WHERE (status = 'pending') <> (premium IS NULL)) AS inconsistent,
    count(*) FILTER (WHERE role = 'validation') AS validation, count(*) FILTER (WHERE role = 'calibration') AS calibration, count(*) FILTER (WHERE role = 'audit') AS audit, count(*) - count(DISTINCT row_key) AS repeated FROM t""")
def journal_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("split", F.col("role"))
    tampered = rows.withColumn("row_key", F.when(F.col("quote_id") % 101 == 0, "x").otherwise(F.col("row_key"))).withColumn("premium", F.when((F.col("quote_id") % 89 == 0) | (F.col("role") == "pool"), F.lit(None)).otherwise(F.col("premium")))
    return journal.integrity(tampered)


# the batch history


_HISTORY = f"""{sql.JOURNAL}, hist AS (SELECT batch_id AS idx, CASE WHEN batch_id % 4 = 3 THEN NULL ELSE avg(abs(premium - predicted)) END AS mae, CASE batch_id % 3 WHEN 1 THEN 'explore' WHEN 2 THEN 'balanced' END AS policy FROM journal WHERE role = 'mapping' GROUP BY batch_id)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, mae (null for one batch in four), policy (null for one in three)."""
    held = samples(spark, sf_dir).filter("role = 'mapping'").groupBy(F.col("batch_id").alias("idx")).agg(F.avg(F.abs(F.col("premium") - F.col("predicted"))).alias("mae"))
    policy = F.when(F.col("idx") % 3 == 1, "explore").when(F.col("idx") % 3 == 2, "balanced")
    return held.select("idx", F.when(F.col("idx") % 4 != 3, F.col("mae")).alias("mae"), policy.alias("policy"))


@query(f"WITH {_HISTORY} SELECT idx, {r('mae')} AS mae FROM hist WHERE mae IS NOT NULL AND isfinite(mae) ORDER BY idx DESC LIMIT 8")
def mae_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.mae_trend(history(spark, sf_dir))


@query(f"WITH {_HISTORY}, p AS (SELECT *, last_value(mae IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM hist) SELECT idx, policy, CASE WHEN mae IS NULL OR prior IS NULL THEN NULL WHEN prior = 0 THEN 0e0 ELSE {r('(prior - mae) / prior')} END AS gain FROM p WHERE policy IS NOT NULL ORDER BY idx DESC LIMIT 1")
def prior_policy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.previous_policy(history(spark, sf_dir))


@query(f"WITH {_HISTORY} SELECT idx, policy, {r('mae', 4)} AS mae, CASE WHEN mae IS NULL THEN 'quoted' ELSE 'evaluated' END AS state FROM hist")
def batch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("idx", "policy", rounded(F.col("mae"), 4).alias("mae"), F.when(F.col("mae").isNull(), "quoted").otherwise("evaluated").alias("state"))


@query(f"""WITH RECURSIVE {_HISTORY}, h AS (SELECT row_number() OVER (ORDER BY idx) AS i, mae, mae * 0.97e0 AS lower, mae * 1.03e0 AS upper FROM hist WHERE mae IS NOT NULL),
    f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS best_mae, CAST(NULL AS DOUBLE) AS best_lower, CAST(0 AS BIGINT) AS stale, false AS stopped
    UNION ALL SELECT h.i, CASE WHEN best_lower IS NULL OR upper < best_lower * (1e0 - 0.005e0) THEN mae ELSE best_mae END, CASE WHEN best_lower IS NULL OR upper < best_lower * (1e0 - 0.005e0) THEN lower ELSE best_lower END,
    CASE WHEN best_lower IS NULL OR upper < best_lower * (1e0 - 0.005e0) THEN 0 ELSE stale + 1 END, h.i >= 3 AND (CASE WHEN best_lower IS NULL OR upper < best_lower * (1e0 - 0.005e0) THEN 0 ELSE stale + 1 END) >= 2 FROM f JOIN h ON h.i = f.i + 1)
    SELECT i AS batches, {r("best_mae")} AS best_mae, stale, stopped AS should_stop FROM f ORDER BY i DESC LIMIT 1""")
def early_stop_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).filter("mae IS NOT NULL").select("idx", "mae", (F.col("mae") * 0.97).alias("lower"), (F.col("mae") * 1.03).alias("upper"))
    return evaluate.early_stop(rows, 2, 3, 0.005)


@query(f"WITH {sql.JOURNAL}, b AS (SELECT DISTINCT batch_id FROM journal WHERE batch_id IS NOT NULL) SELECT b.batch_id, count(*) AS n, {r('avg(abs(premium - predicted))', 4)} AS mae FROM b JOIN journal s ON s.batch_id <= b.batch_id GROUP BY b.batch_id")
def cumulative_batch_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.cumulative_mae(samples(spark, sf_dir))


# candidates and benchmarks


_CANDIDATES = "cand AS (SELECT p_brand AS search, p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'hgb-unconstrained' WHEN 1 THEN 'hgb-monotonic' ELSE 'extra-trees' END || '-' || p_partkey AS name, p_partkey % 3 = 1 AS monotonic, p_retailprice + p_partkey % 7 AS mae, CAST(p_size AS DOUBLE) AS latency_ms FROM part)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search, name, monotonic, mae, latency_ms of candidate models."""
    k = F.col("p_partkey")
    family = F.when(k % 3 == 0, "hgb-unconstrained").when(k % 3 == 1, "hgb-monotonic").otherwise("extra-trees")
    return fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("search"), F.concat(family, F.lit("-"), k).alias("name"), (k % 3 == 1).alias("monotonic"), (F.col("p_retailprice") + k % 7).alias("mae"), F.col("p_size").cast("double").alias("latency_ms"))


def best_candidate(rows: DataFrame, ceiling: float, *keys: str) -> DataFrame:
    """Of candidates whose latency is at most ceiling, the least by (mae, latency, name)."""
    best = rows.filter(F.col("latency_ms") <= ceiling).groupBy(*keys).agg(F.min(F.struct("mae", "latency_ms", "name")).alias("b"))
    return best.select(*keys, "b.name", "b.mae", "b.latency_ms")


@query(f"WITH {_CANDIDATES} SELECT search, name, mae, latency_ms FROM cand WHERE latency_ms <= 25 QUALIFY row_number() OVER (PARTITION BY search ORDER BY mae, latency_ms, name) = 1")
def candidate_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_candidate(candidates(spark, sf_dir), 25.0, "search")


@query(f"WITH {_CANDIDATES} SELECT search, {r('min(mae) FILTER (WHERE monotonic)', 4)} AS constrained, {r('min(mae) FILTER (WHERE NOT monotonic)', 4)} AS unconstrained, {r('min(mae) FILTER (WHERE monotonic) - min(mae) FILTER (WHERE NOT monotonic)', 4)} AS delta FROM cand GROUP BY search")
def monotonic_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    on, off = F.min(F.when(F.col("monotonic"), F.col("mae"))), F.min(F.when(~F.col("monotonic"), F.col("mae")))
    return candidates(spark, sf_dir).groupBy("search").agg(rounded(on, 4).alias("constrained"), rounded(off, 4).alias("unconstrained"), rounded(on - off, 4).alias("delta"))


_RECORDS = "rec AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'lhs' ELSE 'active' END AS strategy, [11, 23, 37, 53, 71][o_custkey % 5 + 1] AS seed, avg(o_totalprice) * (1 - (o_orderkey % 3) * 0.1e0) AS mae, max(o_totalprice) / 1e5 AS latency_ms, avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0.8e0 END) AS coverage, count(*) FILTER (WHERE o_totalprice < 100000) AS eligible FROM orders GROUP BY o_orderkey % 3, o_custkey % 5)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, seed, mae, latency_ms, coverage, eligible: one record for each strategy and seed."""
    s, seeds = F.col("o_orderkey") % 3, F.array(*(F.lit(x) for x in (11, 23, 37, 53, 71)))
    rows = fx.table(spark, sf_dir, "orders").groupBy(s.alias("s"), (F.col("o_custkey") % 5).alias("k"))
    held = rows.agg(F.avg("o_totalprice").alias("a"), F.max("o_totalprice").alias("m"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.8)).alias("coverage"), F.count_if(F.col("o_totalprice") < 100000).alias("eligible"))
    name = F.when(F.col("s") == 0, "random").when(F.col("s") == 1, "lhs").otherwise("active")
    return held.select(name.alias("strategy"), F.element_at(seeds, (F.col("k") + 1).cast("int")).alias("seed"), (F.col("a") * (F.lit(1) - F.col("s") * 0.1)).alias("mae"), (F.col("m") / 1e5).alias("latency_ms"), "coverage", "eligible")


def summary(rows: DataFrame) -> DataFrame:
    """By strategy: median MAE, median and largest latency, mean coverage, eligible candidates."""
    return rows.groupBy("strategy").agg(rounded(F.median("mae"), 4).alias("median_mae"), rounded(F.median("latency_ms")).alias("median_latency"), rounded(F.max("latency_ms")).alias("max_latency"), rounded(F.avg("coverage")).alias("mean_coverage"), F.sum("eligible").alias("eligible"))


@query(f"WITH {_RECORDS} SELECT strategy, {r('median(mae)', 4)} AS median_mae, {r('median(latency_ms)')} AS median_latency, {r('max(latency_ms)')} AS max_latency, {r('avg(coverage)')} AS mean_coverage, CAST(sum(eligible) AS BIGINT) AS eligible FROM rec GROUP BY strategy")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(records(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT a.seed, {r('a.mae', 4)} AS active, {r('l.mae', 4)} AS lhs, {r('(l.mae - a.mae) / nullif(l.mae, 0)')} AS gain, a.mae <= l.mae * 1.1e0 AS within FROM rec a JOIN rec l ON a.seed = l.seed AND a.strategy = 'active' AND l.strategy = 'lhs'")
def seed_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = records(spark, sf_dir).groupBy("seed").pivot("strategy", ["active", "lhs"]).agg(F.first("mae"))
    a, b = F.col("active"), F.col("lhs")
    return wide.select("seed", rounded(a, 4).alias("active"), rounded(b, 4).alias("lhs"), rounded((b - a) / F.nullif(b, F.lit(0.0))).alias("gain"), (a <= b * 1.1).alias("within"))


_SECONDS = "gen AS (SELECT user_id AS batch_id, list(value ORDER BY event_id) AS latencies, max(value) * 2 AS resident FROM events WHERE event_type <> 'error' GROUP BY user_id)"


@query(f"WITH {_SECONDS}, x AS (SELECT unnest(latencies) AS ms FROM gen) SELECT count(*) AS attempts, {r('sum(ms)', 3)} AS total_ms, {r('max(ms)', 3)} AS max_ms, (SELECT {r('max(resident)', 3)} FROM gen) AS max_resident, bool_and(ms <= 60000) AS within FROM x")
def advisor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fx.table(spark, sf_dir, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.collect_list("value").alias("latencies"), (F.max("value") * 2).alias("resident"))
    each = held.select("resident", F.explode("latencies").alias("ms"))
    return each.agg(F.count("*").alias("attempts"), rounded(F.sum("ms"), 3).alias("total_ms"), rounded(F.max("ms"), 3).alias("max_ms"), rounded(F.max("resident"), 3).alias("max_resident"), F.bool_and(F.col("ms") <= 60000).alias("within"))


@query(f"WITH {sql.PRICED}, a AS (SELECT quote_id, premium FROM priced), b AS (SELECT quote_id, predicted FROM priced WHERE claims_5y < 6) SELECT count(*) AS matched, (SELECT count(*) FROM a) - count(*) AS unmatched, {r('avg(abs(premium - predicted))', 4)} AS validation_mae FROM a JOIN b USING (quote_id)")
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.priced(spark, sf_dir)
    both = rows.select("quote_id", "premium").join(rows.filter("claims_5y < 6").select("quote_id", "predicted"), "quote_id", "left")
    found = F.col("predicted").isNotNull()
    return both.agg(F.count_if(found).alias("matched"), F.count_if(~found).alias("unmatched"), rounded(F.avg(F.abs(F.col("premium") - F.col("predicted"))), 4).alias("validation_mae"))
