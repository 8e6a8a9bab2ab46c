"""Toxicity of texts: a weighted lexicon with exception phrases, matched by Aho-Corasick after folding."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.shared import blocks, ready

#: Lower-case letters that look like a-z, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("авекмнорстухіѕјһԁԛԝαβεηικμνορτυχ", "abekmhopctyxisjhdqwabehikmvoptux", strict=True))
SUBSTITUTES = dict(zip("01345789@$€", "oieastbgase", strict=True))
_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
_APART = re.compile(r"[\W_]+")
#: Labelled documents of a class that are learned from, about; lengths of word beginnings; share of toxic documents that
#: an entry is in; log-odds of an entry; those below which a longer phrase is an exception; documents that show it; its
#: most words.
SAMPLE, STARTS, SHARE, ODDS, EXCEPTION_ODDS, SHOWN, SPAN = 20_000, range(4, 11), 0.004, 4.0, 0.5, 2, 3
#: How lengths may be counted: the weights are divided by words to this power.
POWERS = (0.0, 0.25, 0.5, 0.75)

_automata: dict[tuple, object] = {}


def fold(text: str) -> str:
    """Words in lower case with look-alikes folded, each between single spaces."""
    return f" {_APART.sub(' ', text.lower().translate(_FOLD)).strip()} "


def terms_of(folded: str) -> set[str]:
    """What an entry may be: a word, as ' word ', or the beginning of one, as ' begin'."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STARTS if len(w) >= n}


@dataclass(frozen=True)
class Lexicon:
    """Entries and their weights, exception phrases, and how a sum of weights over words becomes a score."""

    entries: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    power: float = 0.0
    slope: float = 1.0
    offset: float = -4.0

    def automaton(self) -> object:
        if self not in _automata:
            import ahocorasick

            found = ahocorasick.Automaton()
            for term, weight in self.entries:
                found.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                found.add_word(phrase, (len(phrase), -1.0))
            if len(found):
                found.make_automaton()
            _automata.clear()
            _automata[self] = found
        return _automata[self]

    def sums(self, text: str) -> tuple[float, int]:
        """(weights of the words with an entry, each word's largest; words). Words in exception phrases don't count."""
        folded = fold(text)
        words = folded.count(" ") - 1
        automaton = self.automaton()
        if not len(automaton) or not words:
            return 0.0, max(words, 0)
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded):
            at = end - length + 1
            if weight < 0:
                spared.append((at, end))
            elif weight > found.get(at, 0.0):
                found[at] = weight
        # the furthest end of the phrases that begin at or before a place covers it, or none does
        spared.sort()
        begins, ends = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        return sum(w for at, w in found.items() if not (k := bisect_right(begins, at)) or ends[k - 1] <= at), words

    def around(self, folded: str) -> set[str]:
        """What an exception may be: each word with an entry and the sequences of at most SPAN words that hold it."""
        automaton = self.automaton()
        hits = {end - length + 1 for end, (length, _) in automaton.iter(folded)} if len(automaton) else set()
        if not hits:
            return set()
        words = folded.split()
        places = dict(zip(accumulate((len(w) + 1 for w in words), initial=0), range(len(words)), strict=False))
        found = set()
        for k in (places[at] for at in hits):
            for i in range(max(0, k - SPAN + 1), k + 1):
                found.update(f" {' '.join(words[i:j])} " for j in range(k + 1, min(len(words), i + SPAN) + 1))
        return found

    def score(self, text: str) -> float:
        weight, words = self.sums(text)
        return 1 / (1 + math.exp(-(self.offset + self.slope * math.log1p(weight / max(words, 1) ** self.power))))


def _labelled(docs: DataFrame, labels: DataFrame, train: F.Column) -> tuple[DataFrame, dict[int, float]]:
    """(text and label of the documents learned from, how many documents stand for each of them, by label).

    About SAMPLE documents of a class at most, by hashed id; their labels are broadcast, and no text is shuffled.
    """
    own = labels.filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = {int(r.toxic): r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, SAMPLE / n) for k, n in rows.items()}
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    some = own.filter(F.lit(False) if not share else drawn < F.coalesce(*(F.when(F.col("toxic") == k, F.lit(s)) for k, s in share.items())))
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    return texts, {k: 1 / s for k, s in share.items()}


def _counted(texts: DataFrame, terms: Callable[[str], set[str]], candidates: frozenset[str] | None = None) -> DataFrame:
    """In how many texts each of their terms is; of candidates only, if they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for block in blocks(batch, "text"):
                for text in block.column("text").to_pylist():
                    found = terms(fold(text))
                    held.update(found if candidates is None else found & candidates)
                if len(held) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _logistic(rows: list[tuple[float, int, float]]) -> tuple[float, float, float]:
    """(slope, offset, loss) for rows of (value, label, how many)."""
    x, y, n = (np.array(c, float) for c in zip(*rows, strict=True))
    a, b = 1.0, -1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(n * (p - y) * x).sum() + 0.01 * a, (n * (p - y)).sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
    p = (1 / (1 + np.exp(-(a * x + b)))).clip(1e-9, 1 - 1e-9)
    return float(a), float(b), float(-(n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def learn(docs: DataFrame, labels: DataFrame, train: F.Column) -> Lexicon:
    """A lexicon from labels (doc_id, toxic) of docs (doc_id, text); train: the labels' rows that may be used.

    Entries: words and beginnings of words that SHARE of the toxic documents hold and whose log-odds are ODDS or
    more; a beginning replaces all that it begins. Exception phrases: words that hold an entry, and sequences of at most
    SPAN words with one, that yet are in SHOWN clean documents and whose log-odds are EXCEPTION_ODDS or less, whether
    toxic documents hold them or not. The score's two numbers and the power of the length that fits
    best come from a logistic regression on the sums that the entries give on the same rows. Without documents of
    both classes there are no entries.
    """
    ready(docs.sparkSession)
    texts, stands = _labelled(docs, labels, train)
    rows = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not rows.get(1) or not rows.get(0):
        return Lexicon()
    least = max(3, math.ceil(SHARE * rows[1]))
    toxic = {r.term: r.n for r in _counted(texts.filter("toxic = 1"), terms_of).filter(F.col("n") >= least).collect()}
    clean = {r.term: r.n for r in _counted(texts.filter("toxic = 0"), terms_of, frozenset(toxic)).collect()}

    def log_odds(n: int, others: int) -> float:
        return math.log((n + 0.5) / (rows[1] + 1)) - math.log((others + 0.5) / (rows[0] + 1))

    odds = {t: log_odds(n, clean.get(t, 0)) for t, n in toxic.items()}
    entries: dict[str, float] = {}
    for term in sorted((t for t in odds if odds[t] >= ODDS), key=lambda t: (len(t), t)):
        if not any(term[:n] in entries for n in range(len(term))):
            entries[term] = round(odds[term], 4)
    bare = Lexicon(tuple(sorted(entries.items())))
    shown = {r.term: r.n for r in _counted(texts.filter("toxic = 0"), bare.around).filter(F.col("n") >= SHOWN).collect()} if entries else {}
    bad = {r.term: r.n for r in _counted(texts.filter("toxic = 1"), bare.around, frozenset(shown)).collect()} if shown else {}
    spared = {t for t, n in shown.items() if log_odds(bad.get(t, 0), n) <= EXCEPTION_ODDS}
    plain = Lexicon(bare.entries, tuple(sorted(spared)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in blocks(batch, "text")):
            found = [plain.sums(x) for x in block.column("text").to_pylist()]
            weights = pa.array([round(w, 1) for w, _ in found], pa.float64())
            words = pa.array([round(2 * math.log2(max(n, 1))) for _, n in found], pa.int32())
            yield pa.RecordBatch.from_arrays([block.column("toxic"), weights, words], names=["toxic", "weight", "words"])

    binned = texts.mapInArrow(sums, "toxic int, weight double, words int").groupBy("toxic", "weight", "words").agg(F.count("*").alias("n"))
    table = [(r.toxic, r.weight, 2 ** (r.words / 2), r.n * stands[r.toxic]) for r in binned.collect()]
    fits = [(*_logistic([(math.log1p(w / words**p), y, n) for y, w, words, n in table]), p) for p in POWERS]
    slope, offset, _, power = min(fits, key=lambda f: f[2])
    return Lexicon(plain.entries, plain.exceptions, power, slope, offset)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and score (0 to 1), from the whole text alone.

    A null text is empty; a text without an entry has the score of a sum of 0; other columns are ignored; repeated
    rows get equal scores; an empty table gives an empty one.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in blocks(batch, "text")):
            scores = pa.array([lexicon.score(x or "") for x in block.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([block.column("id"), scores], names=["id", "score"])

    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
