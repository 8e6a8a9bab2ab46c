"""Secrets in texts: rules verified only on the texts that a trigram index finds for them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.shared import blocks, ready
from premia.llm.trigrams import TrigramIndex, query_of, trigrams_in


@dataclass(frozen=True)
class Rule:
    """Spans of `pattern` whose `group` has at least `least` characters, leftmost and without overlap."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 1


#: A run of hex digits, or AKIA and what may follow, that is long enough is found at the same places as any such run.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE_RULES,
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and spans, array<struct<kind, start, end>> by start, then in the rules' order.

    start and end count code points; end is exclusive. From each rule's pattern comes a Boolean query on trigrams;
    each block of texts gets an inverted index of the trigrams that the queries name, postings are intersected, and
    the pattern is matched only in the texts they leave; a rule without mandatory trigrams scans all. Whole texts are
    searched. A null text is empty and has no spans; other columns are ignored; an empty table gives an empty one.
    """
    ready(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(re.compile(r.pattern, r.flags), query_of(r.pattern, r.flags)) for r in rules]
        index = TrigramIndex(set().union(*(trigrams_in(q) for _, q in compiled)))
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for block in blocks(batch, "text"):
                texts = [x or "" for x in block.column("text").to_pylist()]
                index.build([x.encode() for x in texts])
                found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for order, (rule, (pattern, query)) in enumerate(zip(rules, compiled, strict=True)):
                    for i in index.ask(query).tolist():
                        found[i] += [(m.start(), order, m.end()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                spans = [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(spans, pa.list_(span))], names=["id", "spans"])

    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(search, f"id {kind}, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("id", id_col)


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
