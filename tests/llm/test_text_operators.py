"""Operators on documents against brute-force versions, on rows with every oddity."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from premia.llm import bloom
from premia.llm.eliasfano import EliasFano, encode
from premia.llm.exact import exact_dedup, exact_groups
from premia.llm.language import CrossParser, identify, sample, suffix_automaton
from premia.llm.minhash import links_within, near_groups, shingles
from premia.llm.mixing import fit, mix, repeat, targets
from premia.llm.packing import Windows, merge, pack
from premia.llm.secrets import BASE_RULES, RULES, find_secrets
from premia.llm.shared import F, bucket_of
from premia.llm.token_files import read_token_files, write_token_files
from premia.llm.tokens import Encoder, public_path
from premia.llm.toxicity import Lexicon, fold, learn, score
from premia.llm.trigrams import TrigramIndex, query_of, trigrams_in

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# exact dedup


@pytest.mark.parametrize("bits", [1 << 30, 1 << 15])
def test_exact(docs, bits):
    found = exact_groups(docs, most_bits=bits).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[lower(r.text)].append(r.doc_id)
    want = sorted(((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in found), key=str) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_exact_dedup(docs, clashing, empty):
    kept = exact_dedup(docs).collect()
    assert len(kept) == len({lower(r.text) for r in docs.collect()}) == len({lower(r.text) for r in kept})
    assert exact_dedup(clashing).select(docs.columns).count() == len(kept) and exact_dedup(clashing).columns == clashing.columns
    assert exact_dedup(empty).count() == exact_groups(empty).count() == 0


def test_bloom_never_misses(spark):
    df = spark.range(3000).withColumn("k", F.col("id") % 2000)
    segments = bloom.repeated(df, F.col("k"), 1 << 17)
    flagged = bloom.flag(df, F.col("k"), segments, 1 << 17, "maybe")
    assert flagged.filter("k < 1000 and not maybe").count() == 0 and flagged.filter("k >= 1000 and maybe").count() < 50


# near dedup


def brute_groups(rows, percent=85):
    sets = []
    for r in rows:
        w = lower(r.text).encode().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r.doc_id)
    return [(r.doc_id, len(sets[i]), min((x for x in least[top(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


def test_near(docs, clashing, empty, monkeypatch):
    want = sorted(brute_groups(docs.collect()), key=str)
    for frame in (docs, clashing):
        found = near_groups(frame).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert near_groups(empty).count() == 0
    monkeypatch.setattr("premia.llm.minhash.TASK_SHINGLES", 60)  # every group is compared block by block
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_groups(docs).collect()), key=str) == want


@pytest.mark.parametrize(("percent", "size"), [(85, 62), (80, 45)])
def test_near_finds_pairs_at_the_threshold(spark, percent, size):
    """Each text's copy differs in one word, so in 5 of its shingles: size - 5 are common of size + 5. MISS leaves 0.1 of 2000."""
    assert percent <= 100 * (size - 5) / (size + 5) < percent + 1
    rows = []
    for i in range(2000):
        own = [f"w{i}x{k}" for k in range(size + 4)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:20], "zzz", *own[21:]]))]
    found = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert len([r.doc_id for r in found if r.component_id != r.doc_id // 2 * 2]) <= 1


def test_links_within():
    rng = random.Random(1)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 40))], np.uint64)) for _ in range(80)]
    root = list(range(80))
    for _ in range(80):
        for i in range(80):
            for j in range(80):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 50 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert links_within(sets, 50).tolist() == root


def test_shingles():
    assert len(shingles("A b\x0bC  d e")) == 1 and (shingles("A b C d e") == shingles("a B\tc d E")).all()
    assert len(shingles("a b")) == 1 and len(shingles(" ")) == 0 and shingles("a b") != shingles("a b a b a b")[:1]
    assert len(shingles("É x y z w")) == 1 and shingles("É x y z w") != shingles("é x y z w")


# tokens, packing


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("ab Z.,!'\n\té É1 \x1c\x85　́日🙂<|endoftext|>s"), max_size=60))
def test_pieces_equal_whole_texts(path, text):
    found = _encoder(path).encode([text], 9)[0].tolist()
    assert found == _encoder(path).tokenizer.encode(text, add_special_tokens=False).ids + [9]


_held: dict[str, Encoder] = {}


def _encoder(path):
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def expected(docs, path, end):
    t = Tokenizer.from_file(path)
    return [(r.doc_id, np.array(t.encode(r.text or "", add_special_tokens=False).ids + [end], "<u4")) for r in docs.collect()]


def test_token_files(docs, clashing, empty):
    want = sorted(expected(docs, BYTE, 0), key=lambda x: (x[0] is not None, x[0] or 0))
    found = sorted(read_token_files(write_token_files(docs, BYTE)).collect(), key=lambda r: r.start)
    at = 0
    held = defaultdict(list)
    for i, ids in want:
        held[i].append(ids)
    for r in found:
        assert r.start == at and r.ids_crc32 in {zlib.crc32(x.tobytes()) for x in held[r.doc_id] if len(x) == r.n_tokens}
        at += r.n_tokens
    assert [r.doc_id for r in found] == [i for i, _ in want]
    assert rows_of(read_token_files(write_token_files(clashing, BYTE)).select("doc_id", "n_tokens")) == rows_of(read_token_files(write_token_files(docs, BYTE)).select("doc_id", "n_tokens"))
    assert read_token_files(write_token_files(empty, BYTE)).count() == 0


@settings(max_examples=60, deadline=None)
@given(values=st.lists(st.integers(-(2**40), 2**40), max_size=1500), cut=st.tuples(st.integers(0, 1500), st.integers(0, 1500)))
def test_elias_fano(values, cut):
    values = np.sort(np.array(values, np.int64))
    coded = EliasFano(encode(values))
    a, b = min(cut), max(cut)
    assert coded.slice(0, len(values)).tolist() == values.tolist() and coded.slice(a, b).tolist() == values[a:b].tolist()


def test_elias_fano_is_small():
    ends = np.cumsum(np.full(100_000, 700))
    assert len(encode(ends)) < 100_000 * 12 / 8


def check_pieces(pieces, want, capacity, with_ids=False):
    """Every id lies in one piece; sequences have no gaps and at most `capacity` ids. Returns ids by sequence."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    held = defaultdict(list)
    for i, ids in want:
        held[i].append(ids)
    for i, texts in held.items():
        assert sum(p.length for p in by_doc[i]) == sum(map(len, texts))
        for p in by_doc[i]:
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in texts)
            assert not with_ids or zlib.crc32(p.ids) == p.ids_crc32
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    return {k: sum(p.length for p in v) for k, v in by_sequence.items()}


@pytest.mark.parametrize("with_ids", [False, True])
def test_pack(docs, clashing, empty, with_ids):
    fill = check_pieces(pack(docs, WORD, with_ids=with_ids).collect(), expected(docs, WORD, 1), 2048, with_ids)
    assert sum(fill.values()) / (2048 * len(fill)) > 0.97 and sum(n < 2048 - 16 for n in fill.values()) <= 1
    assert pack(clashing, WORD).count() > 0 and pack(empty, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 70), max_size=60), most=st.integers(1, 5), top_up=st.integers(1, 6))
def test_windows(sizes, most, top_up):
    windows = Windows(20, most, top_up)
    done = []
    for d, n in enumerate(sizes):
        windows.add((d, 0, np.arange(n), n))
        assert len(windows.open) <= most
        done += windows.take()
    assert all(20 - top_up < sum(len(p[2]) for p in w) <= 20 for w in done)
    done += merge(windows.rest(), 20)
    ids = sorted((p[0], int(x)) for w in done for p in w for x in p[2])
    assert ids == [(d, x) for d, n in enumerate(sizes) for x in range(n)]


# mixing


def test_mix(docs, clashing, empty):
    rows = [r.asDict() for r in docs.collect()]
    size = [len((r["text"] or "").encode().split()) for r in rows]
    found = mix(docs).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in found) == sorted((str(r["doc_id"]), n) for r, n in zip(rows, size, strict=True))
    total, by_id = defaultdict(int), {}
    for r, n in zip(rows, size, strict=True):
        total[r["source"]] += n
        by_id[r["doc_id"]] = r["source"]
    aims = targets(dict(total), {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))})
    taken = defaultdict(int)
    for r in found:
        if r.doc_id is not None:
            assert r.source_size == total[by_id[r.doc_id]] and abs(r.target - aims[by_id[r.doc_id]]) < 1e-6
        assert r.taken <= 2 * r["size"]
        taken[r.target] += r.taken
    for s, aim in aims.items():
        assert abs(sum(r.taken for r in found if abs(r.target - aim) < 1e-9) - aim) <= 1 + 30_000 * (s == "s0") or sum(abs(a - aim) < 1e-9 for a in aims.values()) > 1
    assert rows_of(mix(docs.repartition(3))) == sorted(found, key=str) and rows_of(mix(clashing)) == sorted(found, key=str)
    assert mix(empty).count() == 0


def test_targets():
    found = targets({"a": 100, "b": 1000, None: 10}, {"a": 3, "b": 1, None: 2})
    assert found == {"a": 200, None: 20, "b": 1.5 * 1110 - 220}
    assert targets({"a": 0}, {"a": 3}) == {"a": 0}


@settings(max_examples=80, deadline=None)
@given(lengths=st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8), budget=st.integers(0, 400))
def test_fit(lengths, budget):
    found = fit(list(lengths.items()), budget)
    assert all(0 <= k <= lengths[n] for n, k in found.items())
    whole = sum(n * c for n, c in lengths.items())
    got = sum(n * k for n, k in found.items())
    assert got <= min(budget, whole) or not lengths
    if 1 in lengths and lengths[1] >= 40:
        assert got == min(budget, whole)
    assert min(budget, whole) - got < max(lengths, default=1)


def test_fit_exactly():
    assert sum(n * k for n, k in fit([(7, 1000), (11, 500), (1, 10)], 5003).items()) == 5003


def test_repeat(docs):
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = mix(unique)
    times = {r.doc_id: r.taken // r["size"] if r["size"] else 1 for r in mixed.collect()}
    found = defaultdict(int)
    for r in repeat(unique, mixed).collect():
        found[r.doc_id] += 1
    assert dict(found) == {k: v for k, v in times.items() if v}


# language, toxicity, secrets


def test_suffix_automaton():
    rng = random.Random(2)
    codes = [rng.randrange(3) for _ in range(60)]
    step = suffix_automaton(codes)
    inside = {tuple(codes[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(500):
        word = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 8)))
        state = 0
        for c in word:
            state = step[state].get(c) if state is not None else None
        assert (state is not None) == (word in inside)


def test_cross_parsing_counts_longest_matches():
    parser = CrossParser((("a", "the cat sat on the mat"), ("b", "der hund lag auf dem boden")))
    texts = ["the mat sat on a cat", "zzz the cat", "der hund", "x" * 700 + " the cat sat"]
    found, _ = parser.phrases(texts)
    for row, text in zip(found, texts, strict=True):
        for j, sample_text in enumerate(("the cat sat on the mat", "der hund lag auf dem boden")):
            count = 0
            for at in range(0, len(text), 512):
                part, i = text[at : at + 512], 0
                while i < len(part):
                    n = 1
                    while i + n <= len(part) and part[i : i + n] in sample_text:
                        n += 1
                    i += max(1, n - 1)
                    count += 1
            assert row[j] == count


def test_cross_parsing_of_many_letters():
    """Every letter of the samples counts as itself, whatever their number."""
    rng = random.Random(6)
    han, hangul = ([chr(start + i) for i in range(300)] for start in (0x4E00, 0xAC00))
    a, b = ("".join(rng.choices(x, k=900)) for x in (han, hangul))
    samples = (("en", "the cat sat on the mat " * 40), ("ko", b), ("zh", a))
    parser = CrossParser(samples)
    texts = [a[100:180], b[300:390], "".join(rng.choices(han, k=80)), "".join(rng.choices(hangul, k=80)), "ααβ γδ", "the cat"]
    found, _ = parser.phrases(texts)
    for row, text in zip(found, texts, strict=True):
        for j, (_, own) in enumerate(samples):
            count = i = 0
            while i < len(text):
                n = 1
                while i + n <= len(text) and text[i : i + n] in own:
                    n += 1
                i += max(1, n - 1)
                count += 1
            assert row[j] == count
    assert [lang for lang, _ in parser.predict(texts[:4])] == ["zh", "ko", "zh", "ko"]


def test_language(spark, sf_dir, docs, clashing, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = bucket_of(F.col("doc_id"), 4) == 2
    samples = sample(table, ~held)
    found = identify(table, samples).withColumn("held", held).collect()
    assert sum(r.lang == r.lang_pred for r in found if r.held) >= 0.97 * sum(r.held for r in found)
    assert identify(table.withColumn("lang", F.lit("x")).withColumn("source", F.lit("x")), samples).groupBy("lang_pred").count().collect() is not None
    odd = {r.doc_id: r for r in identify(clashing, samples).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (300, 301, 302, 308)) and all(0 <= r.score <= 1 for r in odd.values())
    assert identify(docs, ()).filter("lang_pred <> 'und'").count() == 0 and identify(empty, samples).count() == 0 and sample(empty, F.lit(True)) == ()


def test_language_samples_come_from_anywhere_in_different_texts(spark):
    rng = random.Random(8)
    texts = ["shared header " * 50 + "".join(rng.choices("abcdefgh ", k=4000)) for _ in range(30)] + ["copied words here"] * 400
    ((lang, found),) = sample(spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string"), F.lit(True))
    assert lang == "en" and found.count("copied words here") <= 1
    assert found.count("shared header") * len("shared header ") < len(found) / 2


def test_held_out_rows_teach_nothing(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = bucket_of(F.col("doc_id"), 4) == 2
    assert sample(table, ~held) == sample(table.withColumn("text", F.when(held, "changed").otherwise(F.col("text"))), ~held)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = bucket_of(F.col("doc_id"), 5) == 0
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert learn(table, labels, ~out) == learn(table, flipped, ~out)


def test_toxicity(spark, docs, clashing, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("tree", "house", "stone", "water", "idiom")) for _ in range(rng.randrange(5, 60))) + (" you idiot" if i % 6 == 0 else "")) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)] + [(5, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    lexicon = learn(table, labels, bucket_of(F.col("doc_id"), 5) != 0)
    found = {r.doc_id: r.score for r in score(table, lexicon).collect()}
    assert all((found[i] >= 0.5) == (i % 6 == 0) for i in found)
    text = {r.doc_id: r.score for r in score(spark.createDataFrame([(1, "you 1d10t tree"), (2, "an idiom"), (3, "уоu іdіоt")], "doc_id long, text string"), lexicon).collect()}
    assert text[1] >= 0.5 and text[2] < 0.5 and text[3] >= 0.5
    assert all(0 <= r.score <= 1 for r in score(clashing, lexicon).collect()) and score(empty, lexicon).count() == 0
    assert learn(table, labels.filter("toxic = 0"), F.lit(True)) == Lexicon() and score(docs, Lexicon()).filter("score >= 0.5").count() == 0


def test_exception_phrases():
    lexicon = Lexicon(((" trash", 4.0),), (" trashcan ", " white trash paint "), 0.0, 1.0, -1.0)
    assert lexicon.sums("TR4SH")[0] == 4.0 and lexicon.sums("the trashcan")[0] == 0 and lexicon.sums("white trash paint, trash")[0] == 4.0
    assert fold("Ѕtυрid  1t!") == " stupid it "


def test_exception_phrases_are_learned(spark):
    """From words and sequences that clean documents alone hold."""
    rng = random.Random(4)
    said = {1: ["you trash"], 0: ["stone"] * 394 + ["a trashcan"] * 3 + ["white trash paint"] * 3}
    rows = [(" ".join([*rng.choices(("tree", "house", "water", "river"), k=6), x, *rng.choices(("tree", "house"), k=3)]), y) for y, own in said.items() for x in (own * 100 if y else own)]
    table = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    lexicon = learn(table, labels, F.lit(True))
    assert {" trashcan ", " a trashcan ", " white trash ", " white trash paint "} <= set(lexicon.exceptions)
    assert " trash " not in lexicon.exceptions and not [x for x in lexicon.exceptions if "you" in x]
    found = {r.doc_id: r.score for r in score(table, lexicon).collect()}
    assert all((found[i] >= 0.5) == y for i, (_, y) in enumerate(rows))


def test_secrets(docs, clashing, empty, spark):
    key, run = "AKIA" + "Z" * 16, "0123456789abcdef01234567"
    texts = ["password=abcdef", "PassWD: \"abc\" token = 'abcdefg'", f"x{key}", key[:-1], run, run[:-1] + "g", f"api_key={run}", "é token:abcdef", "passwd=token:abcdef", "ſecret=abcdefg", "ghp_" + "a" * 36, f"{run} {run.upper()}", "-----BEGIN RSA PRIVATE KEY-----"]
    table = spark.createDataFrame(list(enumerate([*texts, None, "", "a b " * 50_000 + "secret=123456"])), "doc_id long, text string")
    assign = re.compile(BASE_RULES[0].pattern, re.I | re.A)
    for r in find_secrets(table).collect():
        x = table.filter(F.col("doc_id") == r.doc_id).first().text or ""
        want = [(m.start(), "assign", m.end()) for m in assign.finditer(x) if len(m[2]) >= 6] + [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20] + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        assert sorted((s.start, s.kind, s.end) for s in r.spans if s.kind in ("assign", "access", "hex")) == sorted(want)
    assert find_secrets(clashing).count() == docs.count() and find_secrets(empty).count() == 0


@pytest.mark.parametrize(("pattern", "flags", "text", "other"), [("abc[0-9]+def", 0, "abc1def", "abcdee"), ("(foo|bar)?baz", 0, "baz", "ba z"), ("colou?r", re.I, "COLOR", "col our"), ("x{3,}yz", 0, "xxxxyz", "xxyz"), ("a(bc|de)fg", 0, "adefg", "abdfg")])
def test_trigram_queries(pattern, flags, text, other):
    query = query_of(pattern, flags)
    assert query is not None
    index = TrigramIndex(trigrams_in(query)).build([text.encode(), other.encode(), b"", text.encode()])
    assert {0, 3} <= set(index.ask(query).tolist()) and 1 not in index.ask(query)
    assert query_of("[0-9a-f]{24,}") is None and query_of("ab|cdef") is None and len(RULES) > 3
