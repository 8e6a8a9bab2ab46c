from __future__ import annotations

import math

import numpy as np
import pytest

from premia.operators import acquire, evaluate, journal


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip(map(float, y), map(float, p), strict=True)), "premium double, predicted double")


def test_metrics(spark):
    found = evaluate.point_metrics(pairs(spark, [100, 200, 300, 400], [110, 190, 330, 360])).first()
    assert (found.n, found.mae, found.wape, found.max_error, found.p95_error) == (4, 22.5, 0.09, 40.0, 40.0)
    assert found.rmse == round(math.sqrt(675), 4)


def test_metrics_without_spread(spark):
    found = evaluate.point_metrics(pairs(spark, [0, 0], [0, 1])).first()
    assert found.wape is None and found.r2 is None


def test_conformal(spark):
    rows = pairs(spark, [100, 200, 300, 400], [110, 190, 330, 360])
    radius = evaluate.conformal_radius(rows, 0.9).first()
    assert (radius.radius, radius.conformal_rank) == (40.0, 4)
    found = evaluate.interval_report(evaluate.conformal_bounds(rows, evaluate.F.lit(40.0))).first()
    assert (found.coverage, found.mean_width) == (1.0, 80.0)


@pytest.mark.parametrize("n", [1, 2, 7, 20, 101])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_higher_quantile(spark, n, q):
    values = np.random.default_rng(n).normal(size=n).round(2)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert evaluate.quantile_higher(rows, "v", q).first().value == np.quantile(values, q, method="higher")


def test_normalized_constant(spark):
    rows = evaluate.normalized(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v")
    assert [r.v for r in rows.collect()] == [0.0, 0.0]


def test_early_stop(spark):
    history = spark.createDataFrame([(0, 10.0, 9.0, 11.0), (1, 9.9, 9.0, 10.8), (2, 9.8, 8.9, 10.7)], "idx long, mae double, lower double, upper double")
    assert [evaluate.early_stop(history.filter(f"idx < {n}"), 2, 2, 0.01).first().should_stop for n in (1, 2, 3)] == [False, False, True]
    assert not evaluate.early_stop(history, 0, 2, 0.01).first().should_stop


def test_previous_policy(spark):
    rows = spark.createDataFrame([(0, 100.0, None), (1, 90.0, "explore")], "idx long, mae double, policy string")
    found = journal.previous_policy(rows).first()
    assert (found.policy, found.gain) == ("explore", 0.1)


def test_greedy_equals_plain_loop():
    rng = np.random.default_rng(3)
    scores, points = rng.random(60), rng.random((60, 4))
    chosen: list[int] = []
    for _ in range(8):
        near = np.array([min((np.linalg.norm(p - points[c]) for c in chosen), default=0.0) for p in points])
        spread = (near - near.min()) / np.ptp(near) if np.ptp(near) else np.zeros(60)
        total = scores if not chosen else 0.5 * scores + 0.5 * spread
        chosen.append(int(np.argmax([-np.inf if i in chosen else t for i, t in enumerate(total)])))
    assert acquire.greedy(scores, points, 8) == chosen


def test_counts():
    assert (acquire.focused_count(20), acquire.focused_count(1), acquire.exploration_count(5, "explore")) == (6, 1, 2)
    with pytest.raises(Exception, match="no such bin"):
        acquire.check_boosts({"v1:num:none:0": 1.1}, {"v1:num:excess:0"})


def test_slices_overlap(spark, valid_row):
    from premia.schema import FIELD_ORDER, quote_schema

    rows = [valid_row | {"driver_age": 20.0, "years_licensed": 1}, valid_row | {"driver_age": 70.0}]
    from pyspark.sql import types as T

    frame = spark.createDataFrame([(*(r[n] for n in FIELD_ORDER), 100.0, 110.0) for r in rows], quote_schema({"premium": T.DoubleType(), "predicted": T.DoubleType()}))
    found = {r["slice"]: r for r in evaluate.slice_report(frame).collect()}
    assert (found["young_driver"].n, found["senior_driver"].n, found["claims_history"].n, found["claims_history"].mae) == (1, 1, 0, None)
