"""Every query of the library: `QUERIES` by name, and `ORACLE` with equivalent DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from premia.functions.numeric import rounded
from premia.operators import acquire, encode, evaluate, sample, validate
from premia.plans import sql
from premia.plans.sql import r
from premia.schema import FIELD_ORDER
from premia.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, and its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return put


def _with_mean(cte: str, table: str, keys: str) -> str:
    return f"WITH {cte}, m AS (SELECT *, avg(premium) OVER (PARTITION BY {keys}) AS mean_y FROM {table})"


# minimum slice and evaluation


@query(f"{_with_mean(sql.SPLIT, 'split_rows', 'split')} SELECT split, {sql.metrics()} FROM m GROUP BY split")
def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.split_rows(fx.priced(spark, sf_dir).filter(validate.row_ok()))
    return evaluate.point_metrics(rows, "split")


@query(f"WITH {sql.QUOTES} SELECT * FROM quotes")
def quotes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.quotes_view(spark, sf_dir)


@query(f"WITH {sql.PRICED} SELECT quote_id, premium FROM priced")
def reference_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.priced(spark, sf_dir).select("quote_id", "premium")


_INVALID = f"""{sql.QUOTES}, bad AS (SELECT * REPLACE (CASE WHEN quote_id % 97 = 1 THEN 16.99e0 ELSE driver_age END AS driver_age, CASE WHEN quote_id % 97 = 2 THEN 200001e0 ELSE vehicle_value END AS vehicle_value,
    CASE WHEN quote_id % 97 = 3 THEN CAST('nan' AS DOUBLE) ELSE postcode_risk END AS postcode_risk, CASE WHEN quote_id % 97 = 4 THEN CAST(floor(driver_age) AS BIGINT) - 15 ELSE years_licensed END AS years_licensed,
    CASE WHEN quote_id % 97 = 5 THEN 'fleet' ELSE usage END AS usage) FROM quotes)"""


@query(f"WITH {_INVALID} SELECT quote_id, {sql.REASONS} AS reasons FROM bad WHERE {sql.REASONS} <> ''")
def domain_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.split_valid(fx.invalid_rows(fx.quotes_view(spark, sf_dir)))[1].select("quote_id", "reasons")


@query(f"WITH {_INVALID} SELECT quote_id, years_licensed, greatest(0, CAST(floor(driver_age) AS BIGINT) - 16) AS most FROM bad WHERE NOT {sql.TENURE_OK}")
def tenure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.invalid_rows(fx.quotes_view(spark, sf_dir)).filter(~validate.tenure_ok()).select("quote_id", "years_licensed", validate.max_tenure().alias("most"))


@query(f"""WITH {_INVALID} SELECT count(*) AS n, count(*) FILTER (WHERE {sql.REASONS} = '') AS accepted, count(*) FILTER (WHERE {sql.REASONS} <> '') AS rejected, count(*) FILTER (WHERE NOT (vehicle_value >= 2000 AND vehicle_value <= 200000)) AS bad_values FROM bad""")
def domain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.invalid_rows(fx.quotes_view(spark, sf_dir)).withColumn("reasons", validate.reject_reasons())
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("reasons") == "").alias("accepted"), F.count_if(F.col("reasons") != "").alias("rejected"), F.count_if(~validate.field_ok("vehicle_value")).alias("bad_values"))


@query(f"""WITH {sql.PRICED}, t AS (SELECT quote_id, CASE quote_id % 5 WHEN 0 THEN premium WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN CAST('inf' AS DOUBLE) WHEN 3 THEN -premium END AS target FROM priced)
    SELECT CASE WHEN target IS NULL THEN 'null' WHEN isnan(target) THEN 'nan' WHEN isinf(target) THEN 'infinite' WHEN target < 0 THEN 'negative' ELSE 'valid' END AS kind, count(*) AS n FROM t GROUP BY kind""")
def target_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("quote_id") % 5
    target = F.when(way == 0, F.col("premium")).when(way == 1, F.lit(float("nan"))).when(way == 2, F.lit(float("inf"))).when(way == 3, -F.col("premium"))
    rows = fx.priced(spark, sf_dir).select(target.alias("target"))
    kind = F.when(validate.target_ok(F.col("target")), "valid").when(F.col("target").isNull(), "null").when(F.isnan("target"), "nan").when(F.abs("target") == float("inf"), "infinite").otherwise("negative")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'run-' || o_orderkey WHEN 1 THEN '-run' WHEN 2 THEN 'run ' || o_orderkey WHEN 3 THEN '' WHEN 4 THEN 'a.b_c-' || o_orderkey ELSE repeat('x', 60 + CAST(o_orderkey % 9 AS INTEGER)) END AS run_id FROM orders)
    SELECT id, regexp_full_match(run_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') AS valid FROM t""")
def run_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("run-"), k)).when(k % 6 == 1, F.lit("-run")).when(k % 6 == 2, F.concat(F.lit("run "), k)).when(k % 6 == 3, F.lit("")).when(k % 6 == 4, F.concat(F.lit("a.b_c-"), k)).otherwise(F.repeat(F.lit("x"), (F.lit(60) + k % 9).cast("int")))
    return fx.table(spark, sf_dir, "orders").select(k.alias("id"), validate.run_id_ok(name).alias("valid"))


_RAW = "CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || '.0' WHEN 1 THEN 'abc' WHEN 2 THEN o_orderkey || '.5' WHEN 3 THEN 'inf' WHEN 4 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END"


@query(f"""WITH t AS (SELECT o_orderkey AS id, TRY_CAST({_RAW} AS DOUBLE) AS x FROM orders), u AS (SELECT id, CASE WHEN isfinite(x) THEN x END AS number FROM t)
    SELECT id, number, CASE WHEN number = floor(number) THEN CAST(number AS BIGINT) END AS whole FROM u""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 6 == 0, F.concat(k, F.lit(".0"))).when(k % 6 == 1, F.lit("abc")).when(k % 6 == 2, F.concat(k, F.lit(".5"))).when(k % 6 == 3, F.lit("inf")).when(k % 6 == 4, F.lit("")).otherwise(k.cast("string"))
    return fx.table(spark, sf_dir, "orders").select(k.alias("id"), validate.parse_number(raw, False).alias("number"), validate.parse_number(raw, True).alias("whole"))


_SLICES = ", ".join(f"CASE WHEN {rule.replace('0.70D', '0.7e0')} THEN '{name}' END" for name, rule in evaluate.SLICES.items())


@query(f"""{_with_mean(sql.SPLIT + f", s AS (SELECT *, unnest(list_filter([{_SLICES}], lambda x: x IS NOT NULL)) AS slice FROM split_rows WHERE split = 'audit')", "s", "slice")},
    names AS (SELECT unnest([{", ".join(repr(n) for n in evaluate.SLICES)}]) AS slice), f AS (SELECT slice, {sql.metrics()} FROM m GROUP BY slice)
    SELECT slice, coalesce(n, 0) AS n, mae, rmse, wape, r2, p95_error, max_error FROM names LEFT JOIN f USING (slice)""")
def risk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.slice_report(fx.split_rows(fx.priced(spark, sf_dir)).filter("split = 'audit'"))


_RADIUS = """cal AS (SELECT list_sort(list(abs(premium - predicted))) AS e, count(*) AS n FROM split_rows WHERE split = 'calibration'), cov AS (SELECT unnest([0.8e0, 0.9e0, 0.95e0]) AS coverage),
    radii AS (SELECT coverage, n, CAST(least(n, ceil((n + 1) * coverage)) AS BIGINT) AS conformal_rank, e[CAST(least(n, ceil((n + 1) * coverage)) AS BIGINT)] AS radius FROM cal, cov)"""


@query(f"WITH {sql.SPLIT}, {_RADIUS} SELECT coverage, n, conformal_rank, {r('radius', 4)} AS radius FROM radii")
def conformal_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.split_rows(fx.priced(spark, sf_dir)).filter("split = 'calibration'")
    found = [evaluate.conformal_radius(rows, c).select(F.lit(c).alias("coverage"), "n", "conformal_rank", rounded(F.col("radius"), 4).alias("radius")) for c in (0.8, 0.9, 0.95)]
    return found[0].unionByName(found[1]).unionByName(found[2])


_BOUNDS = f"{sql.SPLIT}, {_RADIUS}, b AS (SELECT s.*, greatest(0, predicted - radius) AS lower, predicted + radius AS upper FROM split_rows s, radii WHERE coverage = 0.9e0 AND split = 'audit')"


@query(f"""WITH {_BOUNDS} SELECT count(*) AS n, {r("avg(CASE WHEN premium >= lower AND premium <= upper THEN 1e0 ELSE 0e0 END)")} AS coverage, {r("avg(upper - lower)", 4)} AS mean_width,
    {r("median(upper - lower)", 4)} AS median_width, {r(sql.higher("upper - lower", 0.95), 4)} AS p95_width FROM b""")
def interval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.interval_report(_audit_bounds(spark, sf_dir))


def _audit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.split_rows(fx.priced(spark, sf_dir))
    radius = evaluate.conformal_radius(rows.filter("split = 'calibration'"), 0.9).select("radius")
    return evaluate.conformal_bounds(rows.filter("split = 'audit'").crossJoin(F.broadcast(radius)), F.col("radius"))


@query(f"""WITH {_BOUNDS} SELECT quote_id, {r("lower", 4)} AS lower, {r("upper", 4)} AS upper, lower >= 0 AND lower <= predicted AND predicted <= upper AS valid FROM b""")
def prediction_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _audit_bounds(spark, sf_dir).withColumn("premium", F.col("predicted")).withColumn("model_version", F.lit("v1"))
    return rows.select("quote_id", rounded(F.col("lower"), 4).alias("lower"), rounded(F.col("upper"), 4).alias("upper"), validate.prediction_ok().alias("valid"))


@query(f"WITH {sql.SPLIT} SELECT split, " + ", ".join(f"{r(sql.higher('abs(premium - predicted)', q), 4)} AS q{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM split_rows GROUP BY split")
def quantile_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.split_rows(fx.priced(spark, sf_dir)).select("split", F.abs(F.col("premium") - F.col("predicted")).alias("e"))
    found = None
    for q in (0.5, 0.9, 0.95, 0.99):
        one = evaluate.quantile_higher(rows, "e", q, "split").select("split", rounded(F.col("value"), 4).alias(f"q{round(q * 100)}"))
        found = one if found is None else found.join(one, "split")
    return found


@query(f"WITH {sql.PRICED}, x AS (SELECT {sql.norm('abs(premium - predicted)')} AS v FROM priced) SELECT " + ", ".join(f"{r(f'quantile_cont(v, {q}::DOUBLE)')} AS q{round(q * 100)}" for q in (0.0, 0.1, 0.5, 0.9, 1.0)) + " FROM x")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.distribution(fx.priced(spark, sf_dir).select(F.abs(F.col("premium") - F.col("predicted")).alias("v")), "v")


_BOOT = sql.uniform("'4001'", "'boot'", "CAST(b AS VARCHAR)", "CAST(i AS VARCHAR)")


@query(f"""WITH {sql.RUN}, e AS (SELECT rk - 85 AS position, abs(premium - predicted) AS e FROM run_rows WHERE role = 'audit'), dr AS (SELECT b, CAST(floor({_BOOT} * 36) AS BIGINT) AS position FROM range(300) x(b), range(36) y(i)),
    s AS (SELECT b, avg(e) AS mae, sqrt(avg(e * e)) AS rmse FROM dr JOIN e USING (position) GROUP BY b), p AS (SELECT avg(e) AS mae, sqrt(avg(e * e)) AS rmse FROM e)
    SELECT 'mae' AS metric, {r("(SELECT mae FROM p)", 4)} AS estimate, {r("quantile_cont(mae, 0.025::DOUBLE)", 4)} AS lower, {r("quantile_cont(mae, 0.975::DOUBLE)", 4)} AS upper FROM s
    UNION ALL SELECT 'rmse', {r("(SELECT rmse FROM p)", 4)}, {r("quantile_cont(rmse, 0.025::DOUBLE)", 4)}, {r("quantile_cont(rmse, 0.975::DOUBLE)", 4)} FROM s""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = fx.run_rows(fx.priced(spark, sf_dir)).filter("role = 'audit'").select((F.col("rk") - 85).alias("position"), F.abs(F.col("premium") - F.col("predicted")).alias("e"))
    return evaluate.bootstrap(errors, 36, 300, 0.95, 4001)


# allocation and order


@query("""WITH b AS (SELECT unnest([9, 11, 120, 121, 260, 1000]) AS budget), l AS (SELECT budget, unnest([{'ord': 0, 'split': 'validation', 'f': 0.4e0}, {'ord': 1, 'split': 'calibration', 'f': 0.3e0}, {'ord': 2, 'split': 'audit', 'f': 0.3e0}]) AS s FROM b),
    f AS (SELECT budget, s.split AS split, s.ord AS ord, budget * s.f AS raw, CAST(floor(budget * s.f) AS BIGINT) AS base FROM l),
    x AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY raw - base DESC, ord) AS place, budget - sum(base) OVER (PARTITION BY budget) AS extra FROM f)
    SELECT CAST(budget AS BIGINT) AS budget, split, base + CASE WHEN place <= extra THEN 1 ELSE 0 END AS rows FROM x""")
def split_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = spark.createDataFrame([(b, o, s, f) for b in (9, 11, 120, 121, 260, 1000) for o, (s, f) in enumerate((("validation", 0.4), ("calibration", 0.3), ("audit", 0.3)))], "budget long, ord int, split string, share double")
    return largest_remainder(shares, "budget", "share", "split", "ord")


def largest_remainder(shares: DataFrame, budget: str, share: str, label: str, order: str) -> DataFrame:
    """budget, label, rows: floors of budget * share, and one more for the largest remainders, ties by order."""
    raw = F.col(budget) * F.col(share)
    floors = shares.withColumn("raw", raw).withColumn("base", F.floor(raw))
    own = Window.partitionBy(budget)
    place = F.row_number().over(own.orderBy((F.col("raw") - F.col("base")).desc(), order))
    extra = F.col(budget) - F.sum("base").over(own)
    return floors.withColumn("place", place).withColumn("extra", extra).select(budget, label, (F.col("base") + (F.col("place") <= F.col("extra")).cast("long")).alias("rows"))


@query(f"WITH {sql.SPLIT} SELECT split, count(*) AS n, min(rk) AS first, max(rk) AS last FROM split_rows GROUP BY split")
def contiguous_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.split_rows(fx.priced(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"), F.min("rk").cast("long").alias("first"), F.max("rk").cast("long").alias("last"))


@query(f"WITH {sql.SPLIT} SELECT s.split, coalesce(n, 0) AS n FROM (SELECT unnest(['mapping', 'validation', 'calibration', 'audit', 'retired']) AS split) s LEFT JOIN (SELECT split, count(*) AS n FROM split_rows GROUP BY split) USING (split)")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(s,) for s in ("mapping", "validation", "calibration", "audit", "retired")], "split string")
    return names.join(fx.split_rows(fx.priced(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# encodings and keys


@query(f"WITH {sql.QUOTES} SELECT quote_id, " + ", ".join(f"CAST({sql.CODES.get(n, n)} AS DOUBLE) AS {n}" for n in FIELD_ORDER) + " FROM quotes")
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.quotes_view(spark, sf_dir).select("quote_id", *encode.ordinal())


@query(f"WITH {sql.QUOTES}, v AS (SELECT quote_id, {sql.VECTOR_COLUMNS} FROM quotes) SELECT quote_id, " + ", ".join(f"{r(f'v{i:02d}')} AS v{i:02d}" for i in range(23)) + " FROM v")
def scaled_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.quotes_view(spark, sf_dir).select("quote_id", *encode.scaled_one_hot())
    return rows.select("quote_id", *(rounded(F.col(f"v{i:02d}")).alias(f"v{i:02d}") for i in range(23)))


@query(f"WITH {sql.QUOTES} SELECT quote_id, {sql.ROW_KEY} AS row_key FROM quotes")
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.quotes_view(spark, sf_dir).select("quote_id", encode.row_key().alias("row_key"))


@query(f"WITH {sql.QUOTES}, k AS (SELECT {sql.ROW_KEY} AS row_key FROM quotes UNION ALL SELECT {sql.ROW_KEY} FROM quotes WHERE claims_5y = 0) SELECT count(*) AS n, count(DISTINCT row_key) AS keys, (SELECT count(*) FROM (SELECT row_key FROM k GROUP BY row_key HAVING count(*) > 1)) AS repeated FROM k")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx.quotes_view(spark, sf_dir).select(encode.row_key().alias("row_key"), "claims_5y")
    both = keys.select("row_key").unionByName(keys.filter("claims_5y = 0").select("row_key"))
    return both.groupBy("row_key").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("keys"), F.count_if(F.col("c") > 1).alias("repeated"))


@query(f"WITH {sql.SPLIT} SELECT split, sha256(string_agg(p, ',' ORDER BY p)) AS digest FROM (SELECT split, substr({sql.ROW_KEY}, 1, 2) AS pre, sha256(string_agg({sql.ROW_KEY}, ',' ORDER BY {sql.ROW_KEY})) AS p FROM split_rows GROUP BY split, pre) GROUP BY split")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx.split_rows(fx.priced(spark, sf_dir)).select("split", encode.row_key().alias("k"))
    parts = keys.groupBy("split", F.substring("k", 1, 2).alias("pre")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("k"))), 256).alias("p"))
    return parts.groupBy("split").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("p"))), 256).alias("digest"))


@query(f"WITH {sql.QUOTES}, b AS (SELECT unnest({sql.BINS}) AS bin_id FROM quotes) SELECT bin_id, count(*) AS n FROM b GROUP BY bin_id")
def bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.quotes_view(spark, sf_dir).select(F.explode(encode.bin_ids()).alias("bin_id")).groupBy("bin_id").agg(F.count("*").alias("n"))


@query("SELECT unnest([" + ", ".join(repr(b) for b in encode.bin_catalogue()) + "]) AS bin_id")
def bin_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark)


def _catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in encode.bin_catalogue()], "bin_id string")


# generators


def _six(columns: tuple[str, ...]) -> list:
    return [rounded(F.col(c)).alias(c) if c in ("driver_age", "vehicle_value", "postcode_risk", "theft_risk") else F.col(c) for c in columns]


_SIX = ", ".join(f"{r(c)} AS {c}" if c in ("driver_age", "vehicle_value", "postcode_risk", "theft_risk") else c for c in FIELD_ORDER)


@query(f"SELECT i, {_SIX} FROM ({sql.generated(4000, 42, 2, True)})")
def lhs_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.lhs_rows(spark, 4000, 42).select("i", *_six(FIELD_ORDER))


@query(f"SELECT i, {_SIX} FROM ({sql.generated(4000, 42, 1, False)})")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.uniform_rows(spark, 4000, 42, sample.EVALUATION).select("i", *_six(FIELD_ORDER))


_POOL = f"SELECT *, {sql.ROW_KEY} AS row_key FROM ({sql.generated(4000, 42, 2, False)})"


@query(f"""WITH pool AS ({_POOL}), u AS (SELECT {sql.ROW_KEY} AS row_key FROM ({sql.generated(1500, 42, 2, False)})), f AS (SELECT * FROM pool WHERE row_key NOT IN (SELECT row_key FROM u)),
    d AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY i) AS nth FROM f) SELECT i, row_key FROM d WHERE nth = 1 ORDER BY i LIMIT 2000""")
def unique_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = sample.uniform_rows(spark, 1500, 42).select(encode.row_key().alias("row_key"))
    return sample.unique_rows(sample.uniform_rows(spark, 4000, 42), used, 2000).select("i", "row_key")


@query("""WITH t AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c FROM orders), m AS (SELECT k, least(greatest(k % 120 - 10 + 0.5e0, 17e0), 90e0) AS driver_age, CAST(least(greatest(round_even((c % 200) / 2e0, 0), 0), 70) AS BIGINT) AS y FROM t)
    SELECT k AS quote_id, driver_age, greatest(0, least(y, least(70, greatest(0, CAST(floor(driver_age) AS BIGINT) - 16)))) AS years_licensed FROM m""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = fx.quotes_view(spark, sf_dir)
    raw = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("quote_id"), ((F.col("o_orderkey") % 120) - 10 + F.lit(0.5)).alias("driver_age"), ((F.col("o_custkey") % 200) / F.lit(2.0)).alias("years_licensed"))
    rest = quotes.select("quote_id", *(c for c in FIELD_ORDER if c not in ("driver_age", "years_licensed")))
    return sample.canonicalize(raw.join(rest, "quote_id")).select("quote_id", "driver_age", "years_licensed")


@query("SELECT CAST(s AS BIGINT) AS run_seed, b AS batch_id, CAST('0x' || substr(sha256(s || ':' || b || ':policy-advisor-v1'), 1, 8) AS BIGINT) & 2147483647 AS advisor_seed FROM (SELECT unnest([11, 17, 23, 37, 53, 71]) AS s), range(20) t(b)")
def advisor_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(s,) for s in (11, 17, 23, 37, 53, 71)], "run_seed long")
    text = F.concat_ws(":", F.col("run_seed").cast("string"), F.col("batch_id").cast("string"), F.lit("policy-advisor-v1"))
    both = seeds.withColumn("batch_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    return both.select("run_seed", "batch_id", F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647).cast("long")).alias("advisor_seed"))


# acquisition


_VECTORS = f"{sql.RUN}, v AS (SELECT *, {sql.VECTOR_COLUMNS} FROM run_rows)"
_DISTANCE = "sqrt(" + " + ".join(f"(c.v{i:02d} - a.v{i:02d}) * (c.v{i:02d} - a.v{i:02d})" for i in range(23)) + ")"
_NEAREST = f"""{_VECTORS}, residual_nn AS (SELECT quote_id, b.d AS distance, b.a AS anchor_id, b.e AS residual FROM (SELECT c.quote_id, min({{'d': {_DISTANCE}, 'a': a.quote_id, 'e': abs(a.premium - a.predicted)}}) AS b FROM v c, v a WHERE c.role = 'pool' AND a.role = 'validation' GROUP BY c.quote_id)),
    diversity_nn AS (SELECT c.quote_id, min({_DISTANCE}) AS distance FROM v c, v a WHERE c.role = 'pool' AND a.role = 'mapping' GROUP BY c.quote_id)"""
_SPREAD = "premium * stddev_pop(0.9e0 + CAST((quote_id * f) % 201 AS DOUBLE) / 1000e0)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.with_vector(fx.run_rows(fx.priced(spark, sf_dir)))


def _residuals(rows: DataFrame) -> DataFrame:
    anchors = rows.filter("role = 'validation'").withColumn("residual", F.abs(F.col("premium") - F.col("predicted")))
    return acquire.nearest(rows.filter("role = 'pool'"), anchors, "quote_id", "residual")


@query(f"WITH {_NEAREST} SELECT quote_id, anchor_id, {r('distance')} AS distance, {r('residual')} AS residual FROM residual_nn")
def residual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residuals(_vectors(spark, sf_dir)).select("quote_id", "anchor_id", rounded(F.col("distance")).alias("distance"), rounded(F.col("residual")).alias("residual"))


@query(f"WITH {_NEAREST} SELECT quote_id, {r('distance')} AS distance FROM diversity_nn")
def diversity_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return acquire.nearest(rows.filter("role = 'pool'"), rows.filter("role = 'mapping'"), "quote_id").select("quote_id", rounded(F.col("distance")).alias("distance"))


_BREAK = " + ".join(f"exp(-40e0 * (least({', '.join(f'abs(CAST({n} AS DOUBLE) - {p!r}::DOUBLE)' for p in points)}) / {max(float(sql.OUTER_BOUNDS[n][1] - sql.OUTER_BOUNDS[n][0]), 1.0)!r}::DOUBLE))" for n, points in acquire.BREAKPOINTS.items())


@query(f"WITH {sql.QUOTES}, b AS (SELECT quote_id, {_BREAK} AS raw FROM quotes), s AS (SELECT quote_id, {sql.norm('raw')} AS score FROM b) SELECT quote_id, {r('score')} AS score FROM s")
def breakpoint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.quotes_view(spark, sf_dir).select("quote_id", acquire.breakpoint_score().alias("score"))
    return evaluate.normalized(rows, "score").select("quote_id", rounded(F.col("score")).alias("score"))


_FACTORS = (29, 31, 37, 41, 43)
_COMMITTEE = f"com AS (SELECT quote_id, any_value(premium) * avg(0.9e0 + CAST((quote_id * f) % 201 AS DOUBLE) / 1000e0) AS mean, any_value(premium) * stddev_pop(0.9e0 + CAST((quote_id * f) % 201 AS DOUBLE) / 1000e0) AS uncertainty FROM (SELECT quote_id, premium, unnest({list(_FACTORS)}) AS f FROM priced) GROUP BY quote_id)"


def committee_columns() -> list:
    """Mean and population deviation of a fixed committee's predictions, as expressions of one row."""
    members = F.array(*(F.lit(0.9) + ((F.col("quote_id") * f) % 201).cast("double") / 1000.0 for f in _FACTORS))
    mean = F.aggregate(members, F.lit(0.0), lambda a, x: a + x) / float(len(_FACTORS))
    spread = F.sqrt(F.aggregate(F.transform(members, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / float(len(_FACTORS)))
    return [(F.col("premium") * mean).alias("mean"), (F.col("premium") * spread).alias("uncertainty")]


@query(f"WITH {sql.PRICED}, {_COMMITTEE} SELECT quote_id, {r('mean', 4)} AS mean, {r('uncertainty', 4)} AS uncertainty FROM com")
def committee_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.priced(spark, sf_dir).select("quote_id", *committee_columns())
    return rows.select("quote_id", *(rounded(F.col(c), 4).alias(c) for c in ("mean", "uncertainty")))


_SCORES = f"""{_NEAREST}, {_COMMITTEE}, s0 AS (SELECT p.quote_id, c.uncertainty, n.residual, {_BREAK} AS bp, dv.distance AS dv FROM run_rows p JOIN com c USING (quote_id) JOIN residual_nn n USING (quote_id) JOIN diversity_nn dv USING (quote_id)),
    s1 AS (SELECT quote_id, {sql.norm("uncertainty")} AS u, {sql.norm("residual")} AS e, {sql.norm("bp")} AS b, {sql.norm("dv")} AS v FROM s0)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    pool = rows.filter("role = 'pool'")
    own = pool.select("quote_id", *FIELD_ORDER, committee_columns()[1], acquire.breakpoint_score().alias("breakpoint"))
    far = acquire.nearest(pool, rows.filter("role = 'mapping'"), "quote_id").select("quote_id", F.col("distance").alias("diversity"))
    return own.join(_residuals(rows).select("quote_id", "residual"), "quote_id").join(far, "quote_id")


@query(f"WITH {_SCORES}, t AS (SELECT quote_id, u * 0.1e0 + e * 0.05e0 + b * 0.2e0 + v * 0.65e0 AS t FROM s1), z AS (SELECT quote_id, {sql.norm('t')} AS score FROM t) SELECT quote_id, {r('score')} AS score FROM z")
def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.combined(_scores(spark, sf_dir)).select("quote_id", rounded(F.col("score")).alias("score"))


_BOOSTS = {"v1:num:driver_age:0": 1.25, "v1:cat:usage:2": 1.1}
_FACTOR = "greatest(" + ", ".join(f"CASE WHEN list_contains({sql.BINS}, '{b}') THEN {f}e0 ELSE 1e0 END" for b, f in _BOOSTS.items()) + ")"


@query(f"""WITH {_SCORES}, b0 AS (SELECT quote_id, u * 0.6e0 + e * 0.2e0 AS w FROM s1), b1 AS (SELECT quote_id, {sql.norm("w")} AS base FROM b0), f AS (SELECT quote_id, base, {_FACTOR} AS factor FROM b1 JOIN quotes USING (quote_id)),
    z AS (SELECT quote_id, factor, {sql.norm("base * factor")} AS score FROM f) SELECT quote_id, factor, {r("score")} AS score FROM z""")
def policy_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    acquire.check_boosts(_BOOSTS, set(encode.bin_catalogue()))
    return acquire.policy_scores(_scores(spark, sf_dir), "explore", _BOOSTS).select("quote_id", "factor", rounded(F.col("score")).alias("score"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {u}e0, {e}e0, {x}e0)" for n, (u, e, x) in acquire.POLICIES.items()) + ") t(policy, uncertainty, residual, exploration)")
def policy_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, *w) for n, w in acquire.POLICIES.items()], "policy string, uncertainty double, residual double, exploration double")


@query("SELECT c AS count, CAST(greatest(1, least(c, round_even(c * 0.3e0, 0))) AS BIGINT) AS focused, c - CAST(greatest(1, least(c, round_even(c * 0.3e0, 0))) AS BIGINT) AS background, CAST(least(c, round_even(c * 0.4e0, 0)) AS BIGINT) AS exploration FROM range(1, 41) t(c)")
def focused_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c, f := acquire.focused_count(c), c - f, acquire.exploration_count(c, "explore")) for c in range(1, 41)], "count long, focused long, background long, exploration long")


_BIN_LIST = ", ".join(repr(b) for b in encode.bin_catalogue())


@query(f"""WITH {sql.RUN}, {_COMMITTEE}, c AS (SELECT {sql.BINS} AS bins, {sql.norm("uncertainty")} AS u FROM run_rows JOIN com USING (quote_id) WHERE role = 'pool'), w AS (SELECT {sql.BINS} AS bins, {sql.norm("abs(premium - predicted)")} AS e FROM run_rows WHERE role = 'validation'),
    cb AS (SELECT bin_id, count(*) AS n, avg(u) AS u FROM (SELECT unnest(bins) AS bin_id, u FROM c) GROUP BY bin_id), wb AS (SELECT bin_id, count(*) AS n, avg(e) AS e FROM (SELECT unnest(bins) AS bin_id, e FROM w) GROUP BY bin_id)
    SELECT b.bin_id, coalesce(cb.n, 0) AS candidate_count, coalesce(wb.n, 0) AS validation_count, {r("coalesce(u, 0)")} AS uncertainty, {r("coalesce(e, 0)")} AS residual FROM (SELECT unnest([{_BIN_LIST}]) AS bin_id) b LEFT JOIN cb USING (bin_id) LEFT JOIN wb USING (bin_id)""")
def diagnostic_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.run_rows(fx.priced(spark, sf_dir))
    pool = evaluate.normalized(rows.filter("role = 'pool'").select(*FIELD_ORDER, committee_columns()[1]), "uncertainty")
    held = evaluate.normalized(rows.filter("role = 'validation'").select(*FIELD_ORDER, F.abs(F.col("premium") - F.col("predicted")).alias("residual")), "residual")
    return acquire.diagnostic_bins(pool, held, _catalogue(spark))


@query()
def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = sample.lhs_rows(spark, 4000, 42).withColumnRenamed("i", "quote_id")
    scored = evaluate.normalized(pool.withColumn("score", acquire.breakpoint_score()), "score")
    return acquire.greedy_batch(acquire.with_vector(scored).select("quote_id", "score", *(f"v{i:02d}" for i in range(23))), 20)



