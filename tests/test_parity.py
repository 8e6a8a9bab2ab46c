"""Public names, scores of one's own, batches on the driver, exact ranks, drawn attempts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import premia
from premia.operators import acquire, evaluate


def test_exports():
    assert len(premia.__all__) == len(set(premia.__all__)) == 32 and all(hasattr(premia, n) for n in premia.__all__)


def test_own_score(spark):
    """A component of one's own joins the columns; a weight that nothing answers raises."""
    rows = spark.createDataFrame([(i, float(i), 20.0 + i) for i in range(5)], "quote_id long, uncertainty double, driver_age double")
    younger = {"young": lambda table: -table["driver_age"]}
    found = {r.quote_id: r.score for r in acquire.combined(rows, {"uncertainty": 1.0, "young": 3.0}, younger).collect()}
    assert found == pytest.approx({0: 1.0, 1: 0.75, 2: 0.5, 3: 0.25, 4: 0.0})
    with pytest.raises(ValueError, match="young"):
        acquire.combined(rows, {"uncertainty": 1.0, "young": 3.0})


@pytest.mark.parametrize("n", [1, 2, 37, 500])
def test_nth_smallest(spark, n):
    rng = np.random.default_rng(n)
    values = np.concatenate([np.zeros(n // 3), rng.lognormal(0, 5, n - n // 3 * 2), np.full(n // 3, 2.5)])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    for share in (0.0, 0.3, 0.9, 1.0):
        rank = max(1, int(np.ceil(share * n)))
        found = evaluate.nth_smallest(rows, "v", lambda c, share=share: F.greatest(F.lit(1), F.ceil(c * share))).first()
        assert (found.n, found["rank"], found.value) == (n, rank, np.sort(values)[rank - 1])


def test_metrics_in_two_passes(spark):
    rng = np.random.default_rng(3)
    y, e = rng.normal(1e6, 10, 400), rng.normal(0, 5, 400)
    rows = spark.createDataFrame([(int(i % 3), float(a), float(a + b)) for i, (a, b) in enumerate(zip(y, e, strict=True))], "k int, premium double, predicted double")
    for r in evaluate.point_metrics(rows, "k").collect():
        own, err = y[r.k :: 3], np.abs((y + e) - y)[r.k :: 3]
        assert r.n == len(own) and r.r2 == pytest.approx(1 - (err**2).sum() / ((own - own.mean()) ** 2).sum(), abs=2e-6)
        assert r.p95_error == pytest.approx(np.quantile(err, 0.95, method="higher"), abs=1e-4)


def test_many_anchors(spark):
    """More anchors than any fixed bound, in blocks."""
    rng = np.random.default_rng(5)
    names = [f"v{i:02d}" for i in range(acquire.DIMS)]
    points, own = rng.random((1500, acquire.DIMS)), rng.random((50, acquire.DIMS))
    kinds = ", ".join(f"{n} double" for n in names)
    anchors = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], f"id long, {kinds}")
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(own)], f"quote_id long, {kinds}")
    found = {r.quote_id: r for r in acquire.nearest(rows, anchors, "id").collect()}
    gaps = np.sqrt(((own[:, None] - points[None]) ** 2).sum(2))
    assert all(found[i].anchor_id == gaps[i].argmin() and found[i].distance == pytest.approx(gaps[i].min()) for i in range(50))
    with pytest.raises(ValueError, match="anchors"):
        acquire.nearest(rows, anchors, "id", most=1499)
