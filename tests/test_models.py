from __future__ import annotations

import json

import numpy as np
import pytest

from premia.errors import ArtifactError, ModelSelectionError
from premia.models import search
from premia.models.estimators import BOOSTED, EXTRA_TREES, FOREST, MONOTONE, Estimator, GaussianProcess, fit
from premia.operators.encode import ordinal
from premia.operators.sample import uniform_rows
from premia.operators.tariff import premium
from premia.schema import FIELD_ORDER

BOOST = {"learning_rate": 0.1, "max_leaf_nodes": 15, "min_samples_leaf": 5, "l2_regularization": 0.1, "max_iter": 60}
TREES = {"n_estimators": 25, "min_samples_leaf": 1, "max_features": 0.8, "max_depth": None}


@pytest.fixture(scope="module")
def data(spark):
    held = uniform_rows(spark, 500, 5).select(*ordinal(), premium().alias("p")).toPandas()
    x, y = held[list(FIELD_ORDER)].to_numpy(float), held["p"].to_numpy()
    return (x[:350], y[:350]), (x[350:], y[350:])


@pytest.mark.parametrize(("kind", "parameters"), [(BOOSTED, BOOST), (EXTRA_TREES, TREES), (FOREST, TREES)])
def test_fit_beats_the_mean(data, kind, parameters):
    (x, y), (vx, vy) = data
    model = fit(kind, parameters, x, y, 1)
    found = model.predict(vx)
    assert np.abs(found - vy).mean() < 0.75 * np.abs(y.mean() - vy).mean() and (found >= 0).all()
    same = Estimator.from_dict(json.loads(json.dumps(model.to_dict())))
    assert np.array_equal(same.predict(vx), found)
    assert np.allclose([same.predict_one(r.tolist()) for r in vx[:20]], found[:20])


def test_monotone(data):
    (x, y), (vx, _) = data
    model = fit(BOOSTED, BOOST, x, y, 1, monotone=True)
    for name, sign in MONOTONE.items():
        f = FIELD_ORDER.index(name)
        steps = []
        for q in np.linspace(x[:, f].min(), x[:, f].max(), 25):
            rows = vx[:40].copy()
            rows[:, f] = q
            steps.append(model.predict(rows))
        assert (sign * np.diff(np.array(steps), axis=0) >= -1e-9).all(), name


def test_gaussian_process():
    rng = np.random.default_rng(0)
    x = rng.random((80, 5))
    y = 100 + 50 * np.sin(3 * x[:, 0])
    model = GaussianProcess().fit(x, y)
    mean, deviation = model.predict(x)
    assert np.allclose(mean, y, atol=0.1) and (deviation < 1).all()
    assert model.predict(x + 10)[1].min() > 0.9 * y.std()


def test_search(spark, data):
    train, held = data
    specs = search.candidates(1, 17, 15, 10)
    assert [s.name for s in specs] == ["hgb-unconstrained-0", "hgb-monotonic-0", "extra-trees-0"] and specs[0].parameters == specs[1].parameters
    found = search.search(spark, specs, train, held, 5).collect()
    best = search.choose(found, 1000.0)
    assert best["mae"] == min(r["mae"] for r in found)
    with pytest.raises(ModelSelectionError, match="fastest"):
        search.choose(found, 1e-9)


def test_estimator_is_checked():
    with pytest.raises(ArtifactError):
        Estimator.from_dict({"kind": "other", "base": 0, "trees": [1]})
