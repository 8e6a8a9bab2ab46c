"""The pipeline and the registered queries, held against brute-force versions on a small fixture."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import DOCS, odd_docs
from pyspark.sql import functions as F
from test_text_operators import WORD, brute_groups, check_pieces, expected, lower

import __spark_entry__ as entry_module
import corpus_pipeline
from premia.llm.mixing import mix
from premia.llm.queries import QUERIES


def test_registered():
    names = entry_module.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tmp_path):
    rows = [r for r in odd_docs() if r[0] is not None]
    table = spark.createDataFrame(rows, DOCS).dropDuplicates(["doc_id"])
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r for r in docs.collect()}
    after = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == DOCS.names
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after.append(docs)
    ids = [sorted(r.doc_id for r in d.collect()) for d in after]
    assert ids[0] == sorted(i for i, r in texts.items() if r.text and any(c.isalpha() for c in r.text))
    last = {}
    for i in ids[0]:
        last[lower(texts[i].text)] = i
    assert ids[1] == sorted(last.values())
    kept = brute_groups([texts[i] for i in ids[1]])
    assert ids[2] == sorted(i for i, _, c in kept if i == c)
    times = {r.doc_id: r.taken // r["size"] for r in mix(after[2]).collect()}
    assert ids[3] == sorted(i for i, n in times.items() for _ in range(n))
    pieces = corpus_pipeline.STAGES[-1][1](spark, after[3], str(tmp_path)).collect()
    fill = check_pieces(pieces, expected(after[3], WORD, 1), 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == sum(fill.values())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    table = {"op4_vectors": "embeddings", "op7_warc": "pages"}.get(name, "documents")
    key = {"embeddings": "vec_id", "pages": "page_id", "documents": "doc_id"}[table]
    assert set(found[key]) == {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}
    assert len(found) == found[key].nunique() or name == "op8_packing"
    assert not [c for c in found.columns if found[c].isna().any() and c != "refers_to"] and np.isfinite(found[key]).all()
