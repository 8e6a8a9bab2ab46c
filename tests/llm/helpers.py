"""Rows with every oddity, for the tests of this folder."""

from __future__ import annotations

import random

from pyspark.sql import Row
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that operators use inside, as a table may have them too.
CLASHING = ("id", "key", "digest", "keep_id", "kept", "size", "rank", "part", "set", "component_id", "spans", "left", "segment", "maybe", "order")


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))


def odd_docs() -> list[tuple]:
    """Nulls, blanks, very long texts, ties, repeated rows, near copies."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(8, 120)) for _ in range(40)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(base)]
    for k in range(12):  # near copies of one, copies of another
        own = base[3].split()
        own[k % len(own)] = "zzz"
        rows.append((100 + k, " ".join(own), "en", "hot"))
        rows.append((200 + k, base[5].upper() if k % 2 else base[5], "en", "hot"))
    rows += [(300, None, "en", "s1"), (301, "", None, None), (302, " \n\t ", "de", None), (303, "one two", "en", "s2"), (304, "ONE two", "en", None), (305, "É é", None, "s1"), (306, "é é", "de", "s1"), (307, words(rng, 30_000), "en", "s0"), (308, "12 !? 34", "en", "s0")]
    rows += [(None, base[7], "en", "s1"), (None, "only here and nowhere else at all", None, None), (309, "same row", "en", "s1"), (309, "same row", "en", "s1")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def rows_of(df) -> list[Row]:
    return sorted(df.collect(), key=str)
