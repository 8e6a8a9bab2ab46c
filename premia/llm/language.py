"""Language of texts by cross-parsing: suffix automata of labelled text count the phrases that a text falls into."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.shared import blocks, held, ready, trimmed

#: Bounds of the training sample: documents per language, characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 400
#: Characters of a part; the parts of a block of texts are parsed side by side, and then joined where a phrase spans them.
PART = 512
#: Codes of characters: letters that no sample has, anything but letters, what fills up a part, and letters of other
#: languages' samples only.
UNKNOWN, GAP, FILL, OTHER = 0, 1, 2, 3
#: Codes of a language up to which its table has a column for each; with more, transitions are looked up by key.
DENSE = 256
UNDETERMINED = "und"


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the smallest automaton that accepts what occurs in codes."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class CrossParser:
    """Counts, for many texts at once, the longest matches against each language's sample."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.languages = [lang for lang, _ in samples]
        raw = {c for _, text in samples for c in text if c.isalpha()}
        letters = sorted({c.lower() if len(c.lower()) == 1 else c for c in raw})
        self.code = np.full(sys.maxunicode + 1, GAP, np.int32)
        self.code[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = UNKNOWN
        self.letter = self.code == UNKNOWN
        for i, c in enumerate(letters):
            for form in {c, c.upper()}:
                if len(form) == 1:
                    self.code[ord(form)] = OTHER + 1 + i
        for c in raw:  # its lower case has another upper case
            if self.code[ord(c)] == UNKNOWN:
                self.code[ord(c)] = self.code[ord(c.lower())]
        coded = [self._codes(text) for _, text in samples]
        self.bits = [math.log2(max(2, len(c))) for c in coded]
        self.own = [self._renumbered(c, OTHER + 1 + len(letters)) for c in coded]
        self.tables = [self._table(suffix_automaton(own[c].tolist()), int(own.max()) + 1) for own, c in zip(self.own, coded, strict=True)]

    def _codes(self, text: str) -> np.ndarray:
        codes = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = codes == GAP
        again = np.zeros(len(codes), bool)
        again[1:] = gap[1:] & gap[:-1]
        return codes[~again]

    @staticmethod
    def _renumbered(codes: np.ndarray, width: int) -> np.ndarray:
        """A language's own code for each code."""
        own = np.full(width, OTHER, np.int32)
        own[:OTHER] = range(OTHER)
        letters = np.unique(codes[codes > OTHER])
        own[letters] = np.arange(OTHER + 1, OTHER + 1 + len(letters))
        return own

    @staticmethod
    def _table(step: list[dict[int, int]], width: int) -> np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By state and code: twice the next state's row, plus 1 where a phrase ends before that character.

        After the automaton's states comes one for a phrase that is a single character which the sample lacks. With
        more than DENSE codes: keys (state times codes plus code) of all transitions but the first state's, in order,
        twice the states that they lead to, and twice the states that each code leads to at a phrase's beginning.
        """
        own = len(step)
        if width > DENSE:
            begin = np.full(width, own * 2, np.int64)
            begin[list(step[0])] = [to * 2 for to in step[0].values()]
            edges = sorted((state * width + c, to * 2) for state in range(1, own) for c, to in step[state].items())
            return *np.array(edges or [(-1, 0)], np.int64).T.copy(), begin
        begin = np.full(width, own * width * 2, np.int32)
        for c, to in step[0].items():
            begin[c] = to * width * 2
        table = np.tile(begin + 1, (own + 1, 1))
        table[0] = begin
        for state in range(1, own):
            for c, to in step[state].items():
                table[state, c] = to * width * 2
        table[:, FILL] = np.arange(own + 1) * width * 2
        return table.ravel()

    @staticmethod
    def _step(table: np.ndarray | tuple, row: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Twice the next rows, plus 1 where a phrase ends before the character."""
        if not isinstance(table, tuple):
            return table[row + codes]
        keys, states, begin = table
        key = row * len(begin) + codes
        at = np.searchsorted(keys, key).clip(max=len(keys) - 1)
        return np.where(keys[at] == key, states[at], begin[codes] + (row != 0))

    def _parse(self, table: np.ndarray | tuple, codes: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that begin in each part (a column of codes, longest first); before: the part that it goes on from, or -1.

        Every part is parsed as if a phrase began with it. Then the phrase that was open at the end of the part before is
        followed into it until a phrase begins where one did in the first parse; from there on both are the same.
        """
        live = np.searchsorted(-sizes, -np.arange(len(codes)), side="left")  # parts longer than each step
        row = np.zeros(len(sizes), np.int64 if isinstance(table, tuple) else np.int32)
        begins = np.zeros((len(codes), len(sizes)), bool)
        begins[0] = True
        for step, n in enumerate(live.tolist()):
            to = self._step(table, row[:n], codes[step, :n])
            begins[step, :n] |= (to & 1).astype(bool)
            row[:n] = to >> 1
        found = begins.sum(0)
        lanes = np.flatnonzero(before >= 0)
        upto = begins.cumsum(0, dtype=np.int32) if len(lanes) else None
        after = np.full(len(sizes), -1)
        after[before[lanes]] = lanes
        fresh = row.copy()
        while len(lanes):
            own, met = row[before[lanes]], np.zeros(len(lanes), bool)
            count = np.zeros(len(lanes), np.int64)
            open_, step = np.arange(len(lanes)), 0
            while len(open_ := open_[sizes[lanes[open_]] > step]):
                to = self._step(table, own[open_], codes[step, lanes[open_]])
                own[open_] = to >> 1
                count[open_] += to & 1
                meets = (to & 1).astype(bool) & begins[step, lanes[open_]]
                count[open_[meets]] += upto[-1, lanes[open_[meets]]] - upto[step, lanes[open_[meets]]]
                met[open_[meets]] = True
                open_, step = open_[~meets], step + 1
            found[lanes] = count
            ends = np.where(met, fresh[lanes], own)  # where the parses met nowhere in the part, the next one follows from this
            changed = ends != row[lanes]
            row[lanes] = ends
            lanes = after[lanes[changed]]
            lanes = lanes[lanes >= 0]
        return found

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, whether a text has letters). Each whole text is parsed from its first character."""
        parts, owner, lettered = [], [], np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            codes = self._codes(text)
            lettered[i] = bool(((codes == UNKNOWN) | (codes > OTHER)).any())
            for at in range(0, len(codes), PART):
                parts.append(codes[at : at + PART])
                owner.append(i)
        found = np.zeros((len(texts), len(self.tables)), np.int64)
        if not parts:
            return found, lettered
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        sizes = np.array([len(parts[k]) for k in order])
        matrix = np.full((int(sizes[0]), len(parts)), FILL, np.int32)
        column = np.empty(len(parts), np.int64)
        for c, k in enumerate(order):
            matrix[: len(parts[k]), c] = parts[k]
            column[k] = c
        before = np.full(len(parts), -1)
        joined = np.flatnonzero(np.diff(owner) == 0) + 1
        before[column[joined]] = column[joined - 1]
        owners = np.array(owner)[order]
        for j, (table, own) in enumerate(zip(self.tables, self.own, strict=True)):
            np.add.at(found[:, j], owners, self._parse(table, own[matrix], sizes, before))
        return found, lettered

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text: phrases count as the bits that name their places; the fewest win."""
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        phrases, lettered = self.phrases(texts)
        cost = phrases * np.array(self.bits)
        best = cost.argmin(1)
        odds = (cost.min(1, keepdims=True).clip(1e-9) / cost.clip(1e-9)) ** 4
        score = 1 / odds.sum(1)
        return [(self.languages[b], float(s)) if has else (UNDETERMINED, 0.0) for b, s, has in zip(best, score, lettered, strict=True)]


def sample(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """Labelled text per language, in the languages' order: SAMPLE_CHARS characters of SAMPLE_DOCS different texts at most.

    Of the rows where train holds, one of each of SAMPLE_DOCS slots of hashed texts is taken, for each language, so
    that copies count once. Of a longer text the characters are taken at a hashed place, not at its beginning.
    """
    text = F.col(f"`{text_col}`")
    order = F.xxhash64(text)
    start = F.pmod(F.xxhash64(text, F.lit("start")), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    named = [F.col(f"`{lang_col}`").alias("lang"), order.alias("order"), F.substring(text, start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")]
    labelled = docs.filter(train & F.col(f"`{lang_col}`").isNotNull() & (F.length(text) > 0)).select(*named)
    slot = F.pmod("order", F.lit(SAMPLE_DOCS)).alias("slot")
    chosen = {(r.lang, r.first) for r in labelled.groupBy("lang", slot).agg(F.min("order").alias("first")).collect()}
    texts: dict[str, dict[int, str]] = {}
    for r in labelled.filter(F.col("order").isin([f for _, f in chosen])).groupBy("lang", "order").agg(F.min("text").alias("text")).collect():
        if (r.lang, r.order) in chosen:
            texts.setdefault(r.lang, {})[r.order] = r.text
    return tuple((lang, " ".join(own[k] for k in sorted(own))) for lang, own in sorted(texts.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with lang_pred and score (0 to 1) added.

    Each whole text is parsed, once per language, into the longest phrases that occur in that language's sample;
    the language whose phrases take the fewest bits wins, ties by its name. Null texts and texts without a letter
    are `und` with score 0, and so is everything without samples. Only the text decides; repeated rows get equal
    answers; an empty table gives an empty one. Columns of docs that are named lang_pred or score are replaced.
    """
    ready(docs.sparkSession)
    schema = docs.drop("lang_pred", "score").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held(("parser", samples), lambda: CrossParser(samples))
        for batch in batches:
            for block in blocks(batch, text_col):
                found = parser.predict([x or "" for x in block.column(text_col).to_pylist()])
                columns = [*block.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*block.schema.names, "lang_pred", "score"])

    out = type(schema)(list(schema.fields)).add("lang_pred", "string").add("score", "double")
    return docs.select(*(F.col(f"`{c}`") for c in schema.names)).mapInArrow(trimmed(run), out)
