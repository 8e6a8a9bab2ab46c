"""What Python workers keep between stages, and what they are handed at once."""

from __future__ import annotations

import weakref

from helpers import DOCS, odd_docs

import corpus_pipeline
from premia.llm import shared, tokens


class Large:
    pass


def test_one_object_stays():
    path = tokens.public_path("word_bpe_49k.json")
    encoder = weakref.ref(tokens.encoder(path))
    assert tokens.encoder(path) is encoder()
    parser = weakref.ref(shared.held("parser", Large))
    assert encoder() is None and parser() is shared.held("parser", Large)


def test_trim_after_the_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(shared, "trim", lambda: seen.append("trim"))
    assert list(shared.trimmed(lambda batches: (seen.append(b) or b for b in batches))(iter("ab"))) == ["a", "b"]
    assert seen == ["a", "b", "trim"]


def test_language_stage_hands_over_texts_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(odd_docs(), DOCS)
    given, identify = [], corpus_pipeline.identify
    monkeypatch.setattr(corpus_pipeline, "identify", lambda d, *a, **k: given.append(d) or identify(d, *a, **k))
    assert corpus_pipeline.keep_languages(spark, docs, str(tmp_path)).columns == DOCS.names
    assert [kind for _, kind in given[0].dtypes] == [kind for _, kind in docs.dtypes]
