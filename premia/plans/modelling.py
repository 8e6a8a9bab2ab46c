"""Queries that fit and apply models; SQL can't say them, so tests hold them to their contracts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.functions.numeric import rounded
from premia.models import search
from premia.models.estimators import Estimator
from premia.plans.catalogue import query
from premia.plans.runs import samples
from premia.schema import FIELD_ORDER


@query()
def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    train, held = (search.matrices(rows.filter(F.col("role") == r)) for r in ("mapping", "validation"))
    return search.search(spark, search.candidates(2, 42, 60, 60), train, held, 50).drop("model")


@query()
def gbm_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    train, held = (search.matrices(rows.filter(F.col("role") == r)) for r in ("mapping", "validation"))
    found = search.search(spark, [c for c in search.candidates(1, 42, 60, 60) if c.monotone], train, held, 5).first()
    return search.score(rows, Estimator.from_dict(json.loads(found.model)))


@query()
def rf_committee(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    members = search.committee(spark, search.matrices(rows.filter("role = 'mapping'")), 42, 5, 20)
    return search.spread(rows.filter("role = 'pool'"), members)


@query()
def gp_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    return search.gp_spread(rows.filter("role = 'pool'"), rows.filter("role = 'mapping'"))


@query()
def monitor_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAE on the validation rows of a fixed model on all mapping rows up to each batch: a task for each batch."""
    import numpy as np
    import pandas as pd

    from premia.models.estimators import EXTRA_TREES, fit

    rows = samples(spark, sf_dir)
    held = rows.filter("role = 'mapping'").select("batch_id", "premium", *search.ordinal()).toPandas()
    vx, vy = search.matrices(rows.filter("role = 'validation'"))

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        own = held[held["batch_id"] <= key[0]].sort_values(list(FIELD_ORDER))
        parameters = {"n_estimators": max(20, min(80, len(own))), "min_samples_leaf": min(2, len(own)), "max_features": 0.8, "max_depth": 18}
        model = fit(EXTRA_TREES, parameters, own[list(FIELD_ORDER)].to_numpy(float), own["premium"].to_numpy(), 42 + int(key[0]))
        return pd.DataFrame({"batch_id": [int(key[0])], "n": [len(own)], "mae": [float(np.abs(model.predict(vx) - vy).mean())]})

    batches = spark.createDataFrame([(int(b),) for b in sorted(held["batch_id"].unique())], "batch_id long")
    found = batches.groupBy("batch_id").applyInPandas(run, "batch_id long, n long, mae double")
    return found.select("batch_id", "n", rounded(F.col("mae"), 4).alias("mae"))
