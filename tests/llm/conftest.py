from __future__ import annotations

import pytest
from helpers import CLASHING, DOCS, odd_docs
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(odd_docs(), DOCS).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASHING})
