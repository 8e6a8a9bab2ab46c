"""Language ID parses whole texts, whatever their length; predictions and toxicity scores against plain versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from premia.llm import language, toxicity
from premia.llm.language import CrossParser
from premia.llm.queries import QUERIES
from premia.llm.shared import bucket_of


def phrases_in(text: str, sample: str) -> int:
    """Longest matches one after the other; runs of what isn't a letter are one blank."""
    def plain(x: str) -> str:
        out = ""
        for c in x:
            c = c.lower() if c.isalpha() else " "
            out += c if c != " " or not out.endswith(" ") else ""
        return out

    text, sample = plain(text), plain(sample)
    count = i = 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in sample:
            n += 1
        i += max(1, n - 1)
        count += 1
    return count


@pytest.mark.parametrize(("part", "dense"), [(512, 256), (7, 256), (7, 1), (3, 256), (1, 256)])
def test_parts_join(part, dense, monkeypatch):
    """However short the parts are, phrases are those of the whole text, also where one spans several parts."""
    monkeypatch.setattr(language, "PART", part)
    monkeypatch.setattr(language, "DENSE", dense)
    rng = random.Random(part)
    samples = tuple((lang, "".join(rng.choices(letters, k=300))) for lang, letters in (("a", "abc "), ("b", "abd"), ("c", "xyz")))
    parser = CrossParser(samples)
    texts = ["".join(rng.choices("abcdxyz q.", k=rng.randrange(0, 90))) for _ in range(60)] + [own[40:260] + "a" + own[10:200] for _, own in samples] + ["", "q" * 50]
    found, _ = parser.phrases(texts)
    assert found.tolist() == [[phrases_in(text, own) for _, own in samples] for text in texts]


def test_language_query(spark, sf_dir):
    """op1's rows against plain cross-parsing of its own samples."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = language.sample(docs, bucket_of(F.col("doc_id"), 4) != 2)
    texts = {r.doc_id: r.text for r in docs.filter("length(text) < 600").limit(25).collect()}
    found = {r.doc_id: r for r in QUERIES["op1_language"](spark, sf_dir).collect()}
    bits = [math.log2(CrossParser(samples)._codes(own).size) for _, own in samples]
    for i, text in texts.items():
        if not any(c.isalpha() for c in text or ""):
            assert (found[i].lang_pred, found[i].score) == ("und", 0)
            continue
        cost = [phrases_in(text, own) * b for (_, own), b in zip(samples, bits, strict=True)]
        odds = [(min(cost) / c) ** 4 for c in cost]
        assert found[i].lang_pred == samples[cost.index(min(cost))][0] and found[i].score == pytest.approx(1 / sum(odds))


def test_toxicity_query(spark, sf_dir):
    """op3's rows against plain search for its lexicon's entries and exceptions, on tables that hold enough toxic rows."""
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs.select("doc_id", "text"), labels, bucket_of(F.col("doc_id"), 5) != 0)
    found = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows) and lexicon.entries
    for r in rows:
        folded = toxicity.fold(r.text or "")
        words = max(folded.count(" ") - 1, 0)

        def places(term, folded=folded):
            return [i for i in range(len(folded)) if folded.startswith(term, i)] if term in folded else []

        spared = {k for x in lexicon.exceptions for i in places(x) for k in range(i, i + len(x) - 1)}
        best = {}
        for term, weight in lexicon.entries:
            for i in places(term):
                best[i] = max(weight, best.get(i, 0.0))
        total = sum(w for i, w in best.items() if i not in spared)
        want = 1 / (1 + math.exp(-(lexicon.offset + lexicon.slope * math.log1p(total / max(words, 1) ** lexicon.power))))
        assert found[r.doc_id].score == pytest.approx(want) and found[r.doc_id].predicted == (want >= 0.5)
