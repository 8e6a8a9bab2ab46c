"""Rows that repeat ids or have none, columns with the operators' own names, lengths beyond every bound."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import pytest
from helpers import DOCS, odd_docs, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_text_operators import WORD, brute_groups, check_pieces, expected, lower

import corpus_pipeline
from premia.llm import shared
from premia.llm.minhash import links_within, near_dedup, near_groups, shingles
from premia.llm.mixing import cyclic_weights, fit, mix, repeat, targets


def shared_ids():
    """Different texts under one id, near copies under no id."""
    rng = random.Random(12)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = lambda x, k: " ".join([*x.split()[:k], "zzz", *x.split()[k + 1 :]])
    rows = [(5, a), (5, b), (3, near(a, 9)), (None, near(b, 30)), (None, c), (None, near(c, 3)), (8, near(c, 50)), (9, words(rng, 40))]
    rows += [(20, near(b, 2)), (20, near(b, 2)), (None, words(rng, 20)), (30, ""), (30, None), (None, " ")]
    return [(i, t, "en", "s") for i, t in rows]


def test_texts_that_share_an_id(spark):
    frame = spark.createDataFrame(shared_ids(), "doc_id long, text string, lang string, source string").repartition(3)
    found = near_groups(frame).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == sorted(brute_groups(frame.collect()), key=str)


@pytest.mark.parametrize("rows", [None, 3])
def test_near_dedup_keeps_one_of_each_group(spark, docs, rows, monkeypatch):
    if rows:
        monkeypatch.setattr("premia.llm.minhash.TASK_ROWS", rows)
    both = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(shared_ids(), "doc_id long, text string, lang string, source string"))
    both = both.withColumns({c: F.lit(0.25) for c in ("id", "node", "stays", "mark", "__maybe")}).repartition(4)
    held = both.collect()
    sets = [frozenset(shingles(r.text or "").tolist()) for r in held]
    root = list(range(len(held)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(held)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(held)):
        groups[top(i)].append(i)
    found = near_dedup(both).collect()
    assert near_dedup(both).columns == both.columns and len(found) == len(groups)
    kept = Counter((r.doc_id, r.text) for r in found)
    for own in groups.values():
        least = min((held[i].doc_id is None, held[i].doc_id or 0) for i in own)
        assert sum(kept[x] > 0 for x in {(held[i].doc_id, held[i].text) for i in own}) == 1
        assert any(kept[held[i].doc_id, held[i].text] and (held[i].doc_id is None, held[i].doc_id or 0) == least for i in own)
    assert all(r.id == r.node == 0.25 for r in found) and near_dedup(both.limit(0)).count() == 0


def test_links_with_those_before():
    """With `apart`, only pairs across that position count."""
    rng = random.Random(2)
    import numpy as np

    sets = [np.unique(np.array([rng.randrange(50) for _ in range(rng.randrange(1, 40))], np.uint64)) for _ in range(60)]
    for apart in (0, 1, 25, 60):
        root = list(range(60))
        for _ in range(60):
            for i in range(apart):
                for j in range(apart, 60):
                    a, b = set(sets[i].tolist()), set(sets[j].tolist())
                    if 100 * len(a & b) >= 50 * len(a | b):
                        root[i] = root[j] = min(root[i], root[j])
        assert links_within(sets, 50, apart).tolist() == root


def test_fit_of_long_documents():
    """The probe of a budget that documents of more words than any bound fit into."""
    assert sum(n * k for n, k in fit([(70000, 1), (70001, 1), (70002, 1)], 100000).items()) == 70002
    assert sum(n * k for n, k in fit([(1_000_000, 3), (600_001, 2), (7, 1)], 1_600_008).items()) == 1_600_008


@settings(max_examples=60, deadline=None)
@given(lengths=st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=5), budget=st.integers(0, 150), bound=st.sampled_from([1, 1 << 16]))
def test_fit_is_near(lengths, budget, bound):
    """Exact above the even part and what the longest give first: within the program's bound, against all choices."""
    import premia.llm.mixing as mixing

    had, mixing.DP_BUDGET = mixing.DP_BUDGET, bound
    try:
        found = fit(list(lengths.items()), budget)
    finally:
        mixing.DP_BUDGET = had
    whole, got = sum(n * c for n, c in lengths.items()), sum(n * k for n, k in found.items())
    assert got <= budget and all(0 <= k <= lengths[n] for n, k in found.items())
    if bound > 1 and budget < whole:  # all that is left after the even part is settled at once
        even = {n: c * budget // whole for n, c in lengths.items()}
        base = sum(n * k for n, k in even.items())
        assert got == max(s for k in itertools.product(*(range(c - even[n] + 1) for n, c in lengths.items())) if (s := base + sum(a * b for a, b in zip(lengths, k, strict=True))) <= budget)


def test_mix_meets_its_targets_exactly(docs):
    """Each source's words are its base and the nearest sum that fit() finds below what is left of its target."""
    size, rows = defaultdict(int), docs.collect()
    lengths = defaultdict(Counter)
    for r in rows:
        n = len((r.text or "").encode().split())
        size[r.source] += n
        lengths[r.source][n] += 1
    aims = targets(dict(size), cyclic_weights(sorted(size, key=lambda s: (s is None, s or ""))))
    source = defaultdict(set)
    for r in rows:
        source[r.doc_id, len((r.text or "").encode().split())].add(r.source)
    taken = defaultdict(int)
    for r in mix(docs).collect():
        (own,) = source[r.doc_id, r["size"]] if len(source[r.doc_id, r["size"]]) == 1 else (next(s for s in source[r.doc_id, r["size"]] if aims[s] == r.target),)
        assert (r.source_size, r.target) == (size[own], aims[own])
        taken[own] += r.taken
    for s, aim in aims.items():
        base = int(aim // size[s]) if size[s] else 0
        assert taken[s] == base * size[s] + sum(n * k for n, k in fit(list(lengths[s].items()), round(aim - base * size[s])).items())
        assert abs(taken[s] - aim) <= 1 or lengths[s][30_000]


def test_repeat_gives_what_the_mix_takes(spark):
    rng = random.Random(7)
    rows = [(1, words(rng, 9), "a"), (1, words(rng, 14), "a"), (None, "x y", "b"), (None, "x y", "b"), (None, "x y", "a"), (2, "", "a"), (2, None, None)]
    rows += [(10 + i, words(rng, 1 + i % 7), "ab"[i % 2]) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("id", "order", "__rows")}).repartition(3)
    mixed = mix(table)
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id, r["size"]] += r.taken // r["size"] if r["size"] else 1
    found = Counter((r.doc_id, len((r.text or "").split())) for r in repeat(table, mixed).collect())
    assert found == Counter({k: n for k, n in want.items() if n}) and repeat(table, mixed).columns == table.columns


def test_no_folder_of_ones_own_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())


def test_pipeline_on_every_oddity(spark, tmp_path):
    """Null and repeated ids, and columns named as predictions are."""
    table = spark.createDataFrame(odd_docs() + [(i, t, None, None, None) for i, t, *_ in shared_ids()], DOCS)
    table = table.withColumns({"score": F.lit(0.25), "lang_pred": F.lit("mine"), "row": F.lit(1)}).repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs, after = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after.append(docs)
        assert docs.filter("score = 0.25 and lang_pred = 'mine' and row = 1").count() == docs.count() > 0
    rows = [d.collect() for d in after]
    lettered = [r for r in before if any(c.isalpha() for c in r.text or "")]
    assert Counter((r.doc_id, r.text) for r in rows[0]) == Counter((r.doc_id, r.text) for r in lettered)
    assert all(r.lang for r in rows[0]) and {(r.doc_id, r.lang) for r in lettered if r.lang} <= {(r.doc_id, r.lang) for r in rows[0]}
    assert Counter(lower(r.text) for r in rows[1]) == Counter({lower(r.text) for r in rows[0]})
    groups = {(i, n, c) for i, n, c in brute_groups(rows[1])}
    assert len(rows[2]) == len(near_groups(after[1]).select("component_id").distinct().collect()) + _apart(groups, rows[1]) - 1
    mixed = sum(r.taken for r in mix(after[2]).collect())
    assert sum(len(r.text.split()) for r in rows[3]) == mixed
    pieces = corpus_pipeline.STAGES[-1][1](spark, after[3], str(tmp_path)).collect()
    fill = check_pieces(pieces, expected(after[3], WORD, 1), 2048)
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(fill.values())


def _apart(groups, rows):
    """Groups that near_groups gives one component_id: those of different texts under one id, and those without any id."""
    sets = [frozenset(shingles(r.text or "").tolist()) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    return len({top(i) for i in range(len(rows))}) - len({c for _, _, c in groups}) + 1
