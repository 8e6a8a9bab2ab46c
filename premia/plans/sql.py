"""SQL of the fixtures and rules that the oracle's queries share."""

from __future__ import annotations

from premia.operators import tariff
from premia.schema import CATEGORICAL, CONTINUOUS, FIELD_ORDER, INTEGER, LEVELS, NUMERIC, OUTER_BOUNDS


def r(value: str, places: int = 6) -> str:
    """The rounding rule: the scaled value rounded half to even."""
    return f"(round_even(({value}) * 1e{places}, 0) / 1e{places})"


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def uniform(*parts: str) -> str:
    """The hash-based uniform; parts are SQL texts."""
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0)"


def higher(value: str, q: float) -> str:
    """Aggregate: element ceil(q * (n - 1)) of the sorted values."""
    return f"list_sort(list({value}))[CAST(ceil({q!r}::DOUBLE * (count(*) - 1)) AS BIGINT) + 1]"


def case(name: str, factors: dict[str, float]) -> str:
    return "(CASE " + " ".join(f"WHEN {name} = '{k}' THEN {d(v)}" for k, v in factors.items()) + " END)"


QUOTES = """q0 AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c, CAST(c_nationkey AS BIGINT) AS nk, CAST(o_totalprice AS DOUBLE) AS price,
        o_orderstatus AS st, substr(o_orderpriority, 1, 1) AS pr, c_mktsegment AS seg, CAST(17.0 AS DOUBLE) + CAST((CAST(o_custkey AS BIGINT) * 7 + CAST(o_orderkey AS BIGINT) * 13) % 7301 AS DOUBLE) / 100e0 AS age
        FROM orders JOIN customer ON o_custkey = c_custkey),
    quotes AS (SELECT k AS quote_id, age AS driver_age, least((k * 3 + c) % 71, greatest(0, CAST(floor(age) AS BIGINT) - 16)) AS years_licensed, 1998 + k % 29 AS vehicle_year,
        least(greatest(price * 0.4e0, 2000e0), 200000e0) AS vehicle_value, 1000 + (k * 37 + c * 11) % 59001 AS annual_km, (c + k) % 7 AS claims_5y, (c * 5 + k) % 7 AS convictions_5y,
        CAST((nk * 37 + c) % 1001 AS DOUBLE) / 1000e0 AS postcode_risk, CAST((k * 17) % 1001 AS DOUBLE) / 1000e0 AS theft_risk, (k * 53 + c * 3) % 5001 AS excess,
        CASE WHEN seg = 'HOUSEHOLD' THEN 'private' WHEN seg IN ('AUTOMOBILE', 'FURNITURE') THEN 'commute' ELSE 'business' END AS usage,
        CASE WHEN st = 'F' THEN 'garage' WHEN st = 'O' THEN 'driveway' ELSE 'street' END AS parking,
        CASE WHEN pr IN ('1', '2') THEN 'premium' WHEN pr = '3' THEN 'basic' ELSE 'none' END AS hire_car,
        CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END AS windscreen, CASE WHEN c % 3 = 0 THEN 'agreed' ELSE 'market' END AS rating FROM q0)"""

_BANDS = "(CASE " + " ".join(f"WHEN driver_age < {d(b)} THEN {d(v)}" for b, v in tariff.AGE_FACTORS) + f" WHEN driver_age >= {d(tariff.SENIOR_AGE)} THEN {d(tariff.SENIOR_FACTOR)} ELSE 1e0 END)"
_VEHICLE_AGE = "greatest(0, 2026 - vehicle_year)"
RAW_PREMIUM = " * ".join([
    f"({d(tariff.BASE)} + {d(tariff.VALUE_RATE)} * vehicle_value)", f"(1e0 + {d(tariff.POSTCODE_RATE)} * postcode_risk)",
    f"(1e0 + 0.01e0 * least({_VEHICLE_AGE}, 10) + 0.02e0 * greatest(0, {_VEHICLE_AGE} - 10))", _BANDS,
    "(1e0 - 0.06e0 * tanh((years_licensed - 3) / 6e0))",
    "((1e0 + 0.22e0 * CAST(claims_5y AS DOUBLE) + 0.28e0 * convictions_5y) * (1e0 + (CASE WHEN claims_5y > 0 THEN 0.1e0 * postcode_risk ELSE 0.1e0 * postcode_risk * 0e0 END)))",
    f"((1e0 + 0.55e0 * theft_risk) * {case('parking', tariff.PARKING)})", case("usage", tariff.USAGE),
    "(1e0 + 0.11e0 * tanh((annual_km - 12000) / 12000e0))", case("hire_car", tariff.HIRE_CAR), case("windscreen", tariff.WINDSCREEN), case("rating", tariff.RATING),
    "(1e0 - 0.16e0 * tanh((excess - 600) / 700e0))",
])
PRICED = QUOTES + f""",
    p0 AS (SELECT *, {r(f"greatest({RAW_PREMIUM}, {d(tariff.FLOOR)})", 2)} AS premium FROM quotes),
    priced AS (SELECT *, premium * (0.9e0 + CAST((quote_id * 29) % 201 AS DOUBLE) / 1000e0) AS predicted FROM p0)"""
RANKED = PRICED + """,
    ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:split:' || quote_id), quote_id) AS rk, count(*) OVER () AS n FROM priced)"""
SPLIT = RANKED + """,
    split_rows AS (SELECT *, CASE WHEN rk <= floor(48e0 * n / 380e0) THEN 'validation' WHEN rk <= floor(84e0 * n / 380e0) THEN 'calibration' WHEN rk <= floor(120e0 * n / 380e0) THEN 'audit' ELSE 'mapping' END AS split FROM ranked)"""
RUN = RANKED + """,
    run_rows AS (SELECT *, CASE WHEN rk <= 48 THEN 'validation' WHEN rk <= 84 THEN 'calibration' WHEN rk <= 120 THEN 'audit' WHEN rk <= 380 THEN 'mapping' ELSE 'pool' END AS role FROM ranked)"""
#: The journal: mapping rows of the run in batches of 20, holdouts, the pool pending.
JOURNAL = RUN + """,
    journal AS (SELECT *, CASE WHEN role = 'mapping' THEN (rk - 121) // 20 END AS batch_id, CASE WHEN role = 'pool' THEN 'pending' ELSE 'complete' END AS status FROM run_rows)"""
ATTEMPTS = """attempts AS (SELECT event_id AS id, 'p' || (user_id % 3) AS provider_identity, CASE WHEN event_type <> 'error' THEN 'success' WHEN value < 50 THEN 'retryable_failure' ELSE 'permanent_failure' END AS outcome,
        CASE WHEN event_type = 'error' AND value < 50 THEN 'ProviderUnavailable' WHEN event_type = 'error' THEN 'ProviderRejected' END AS error_type, CAST(value AS DOUBLE) AS latency_ms, ts AS occurred_at FROM events)"""

FIELDS = ", ".join(FIELD_ORDER)
ROW_KEY = "sha256(concat_ws('|', " + ", ".join(f"CAST(CAST(round_even({n} * 1e6, 0) AS BIGINT) AS VARCHAR)" if n in CONTINUOUS else f"CAST({n} AS VARCHAR)" for n in sorted(FIELD_ORDER)) + "))"
VECTOR = [f"(CAST({n} AS DOUBLE) - {d(float(OUTER_BOUNDS[n][0]))}) / ({d(float(OUTER_BOUNDS[n][1]))} - {d(float(OUTER_BOUNDS[n][0]))})" for n in NUMERIC] + [f"(CASE WHEN {n} = '{x}' THEN 1e0 ELSE 0e0 END)" for n in CATEGORICAL for x in LEVELS[n]]
VECTOR_COLUMNS = ", ".join(f"{x} AS v{i:02d}" for i, x in enumerate(VECTOR))
CODES = {n: f"list_position([{', '.join(repr(x) for x in LEVELS[n])}], {n}) - 1" for n in CATEGORICAL}
BINS = "[" + ", ".join(
    [f"'v1:num:{n}:' || CAST(least(floor(least(greatest(({n} - {d(float(OUTER_BOUNDS[n][0]))}) / ({d(float(OUTER_BOUNDS[n][1]))} - {d(float(OUTER_BOUNDS[n][0]))}), 0e0), 1e0) * 4), 3) AS BIGINT)" for n in NUMERIC] + [f"'v1:cat:{n}:' || ({CODES[n]})" for n in CATEGORICAL]
) + "]"
_OK = {n: f"coalesce({n} BETWEEN {OUTER_BOUNDS[n][0]!r} AND {OUTER_BOUNDS[n][1]!r} AND NOT isnan(CAST({n} AS DOUBLE)), false)" for n in NUMERIC} | {n: f"coalesce({n} IN ({', '.join(repr(x) for x in LEVELS[n])}), false)" for n in CATEGORICAL}
TENURE_OK = "coalesce(years_licensed <= greatest(0, CAST(floor(driver_age) AS BIGINT) - 16), false)"
REASONS = "concat_ws(',', " + ", ".join([f"CASE WHEN NOT {_OK[n]} THEN '{n}' END" for n in FIELD_ORDER] + [f"CASE WHEN NOT {TENURE_OK} THEN 'tenure' END"]) + ")"


def metrics(e: str = "abs(premium - predicted)", y: str = "premium") -> str:
    """The columns of point_metrics over rows with mean_y."""
    return f"""count(*) AS n, {r(f"avg({e})", 4)} AS mae, {r(f"sqrt(avg({e} * {e}))", 4)} AS rmse, {r(f"sum({e}) / nullif(sum(abs({y})), 0)")} AS wape,
        {r(f"1e0 - sum({e} * {e}) / nullif(sum(({y} - mean_y) * ({y} - mean_y)), 0)")} AS r2, {r(higher(e, 0.95), 4)} AS p95_error, {r(f"max({e})", 4)} AS max_error"""


def norm(value: str) -> str:
    """value scaled to 0..1 over all rows."""
    low, high = f"min({value}) OVER ()", f"max({value}) OVER ()"
    return f"(CASE WHEN {high} > {low} THEN (({value}) - {low}) / ({high} - {low}) ELSE 0e0 END)"


def generated(n: int, seed: int, stream: int, lhs: bool, batch: int = 0) -> str:
    """SELECT of generated rows: i and the fields."""

    def draw(name: str) -> str:
        return uniform(f"'{seed}'", f"'{stream}'", f"'{batch}'", f"'{name}'", "CAST(i AS VARCHAR)")

    columns = {}
    for name in CONTINUOUS:
        low, high = (float(x) for x in OUTER_BOUNDS[name])
        place = f"row_number() OVER (ORDER BY md5(concat_ws(':', '{seed}', '{stream}', '{batch}', '{name}-order', CAST(i AS VARCHAR))), i) - 1"
        point = f"(CAST({place} AS DOUBLE) + {draw(name)}) / {d(float(n))}" if lhs else draw(name)
        columns[name] = f"least(greatest({d(low)} + {point} * {d(high - low)}, {d(low)}), {d(high)})"
    for name in INTEGER:
        low, high = OUTER_BOUNDS[name]
        columns[name] = f"{low} + CAST(floor({draw(name)} * {d(float(high - low + 1))}) AS BIGINT)"
    for name in CATEGORICAL:
        columns[name] = f"[{', '.join(repr(x) for x in LEVELS[name])}][CAST(floor({draw(name)} * {len(LEVELS[name])}e0) AS BIGINT) + 1]"
    inner = ", ".join(f"{columns[c]} AS {c}" for c in FIELD_ORDER)
    outer = ", ".join("greatest(0, least(years_licensed, least(70, greatest(0, CAST(floor(driver_age) AS BIGINT) - 16)))) AS years_licensed" if c == "years_licensed" else c for c in FIELD_ORDER)
    return f"SELECT i, {outer} FROM (SELECT i, {inner} FROM range({n}) t(i))"
