"""Exact deduplication by two-pass Bloom filtering, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm import bloom
from premia.llm.shared import ascii_lower, materialize, whole_row


def _digest(text: str) -> F.Column:
    return F.sha2(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), 256)


def _judged(docs: DataFrame, id_col: str, text_col: str, most_bits: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(id and digest of each row, the filter, groups of digests that it lets through, bits)."""
    hashes = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(_digest(text_col)).alias("digest")), "digests")
    bits = bloom.filter_bits(hashes.count(), most=most_bits)
    segments = materialize(bloom.repeated(hashes, F.col("digest"), bits), "filter")
    maybe = bloom.flag(hashes, F.col("digest"), segments, bits, "maybe").filter("maybe")
    groups = materialize(maybe.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return hashes, segments, groups, bits


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 30) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, digest (SHA-256, lower-case hex).

    Texts are equal when they are identical after lower-casing A-Z; null is the empty text. The largest id of a
    group stays. Pass one counts hits of Bloom cells and keeps those hit twice; pass two shuffles only rows whose
    cells were all hit twice, and the rest pass straight through as groups of one. A null id is smaller than any
    other and stays only in a group without ids. Rows that repeat an id count one by one and share its verdict.
    Other columns are ignored; an empty table gives an empty one.
    """
    hashes, segments, groups, bits = _judged(docs, id_col, text_col, most_bits)
    flagged = bloom.flag(hashes, F.col("digest"), segments, bits, "maybe")
    rest = flagged.filter("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    found = flagged.filter("maybe").join(groups, "digest").select("id", "keep_id", "group_size", "digest")
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    return rest.unionByName(found).select(F.col("id").alias(id_col), "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 30) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat id and text, any one stays.

    Only rows that the filter lets through and that have the id that stays are shuffled with their texts. Nulls, repeated
    rows and empty tables are as exact_groups has them.
    """
    _, segments, groups, bits = _judged(docs, id_col, text_col, most_bits)
    rows = docs.select(whole_row(docs), F.col(f"`{id_col}`").alias("id"), F.unhex(_digest(text_col)).alias("digest"))
    flagged = bloom.flag(rows, F.col("digest"), segments, bits, "maybe")
    found = flagged.filter("maybe").join(groups, "digest").filter(F.col("id").eqNullSafe(F.col("keep_id")))
    once = found.groupBy("digest").agg(F.first("row").alias("row"))
    return flagged.filter("not maybe").select("row").unionByName(once.select("row")).select(*(F.col(f"row.`{c}`") for c in docs.columns))
