"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.llm.exact import exact_dedup
from premia.llm.language import UNDETERMINED, identify, sample
from premia.llm.minhash import near_dedup
from premia.llm.mixing import mix, repeat
from premia.llm.packing import pack
from premia.llm.shared import materialize
from premia.llm.tokens import public_path


#: Languages that stay; None: all that can be learned from the labelled documents.
LANGUAGES: frozenset[str] | None = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (null, or not a letter) go, and those outside LANGUAGES.

    Documents that stay without a label get the language that was found as their lang.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # none of which clashes with the operator's own
    found = identify(docs.toDF(*names), sample(docs, F.lit(True)), text_col=names[docs.columns.index("text")])
    known = F.col("lang_pred") != UNDETERMINED
    kept = found.filter(known if LANGUAGES is None else known & F.col("lang_pred").isin(*LANGUAGES))
    return kept.select(*((F.col(n) if c != "lang" else F.coalesce(n, "lang_pred")).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, the row with the largest doc_id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of documents linked at 0.85 or more, the one with the smallest doc_id stays."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents as often as their sources' targets take them; those of no words, once."""
    return repeat(docs, mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of at most 2048 tokens and where they stand in their sequences."""
    return pack(docs, public_path("word_bpe_49k.json"), end=1).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
