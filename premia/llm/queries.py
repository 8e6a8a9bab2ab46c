"""The queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.llm import toxicity
from premia.llm.exact import exact_groups
from premia.llm.language import identify, sample
from premia.llm.minhash import near_groups
from premia.llm.mixing import mix
from premia.llm.packing import pack
from premia.llm.secrets import BASE_RULES, find_secrets, span_text
from premia.llm.shared import bucket_of
from premia.llm.token_files import read_token_files, write_token_files
from premia.llm.tokens import public_path
from premia.llm.vectors import near_vectors
from premia.llm.warc import read_archives, resolve, rewrite_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), sample(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score(docs, lexicon)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]
    kind = F.transform("spans", lambda x: x["kind"])
    counts = [F.size(F.array_remove(kind, k)) for k in kinds]
    counts = [(F.size("spans") - n).cast("long").alias(f"n_{k}") for n, k in zip(counts, kinds, strict=True)]
    base = span_text(F.filter("spans", lambda x: x["kind"].isin(kinds)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = resolve(write_archives(_table(spark, sf_dir, "pages")))
    return read_archives(rewrite_archives(headers)).drop("uri")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end=1).drop("ids")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end=0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_minhash": op2_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_vectors": op4_vectors,
    "op5_secrets": op5_secrets,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_files": op10_token_files,
}

#: The letters of base32, five bits each; DuckDB gives SHA-1 in hexadecimal, of which five digits make four letters.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGEST = " || ".join(
    f"substr('{_BASE32}', CAST((('0x' || substr(hex, {5 * k + 1}, 5))::BIGINT >> {5 * (3 - j)}) & 31 AS INTEGER) + 1, 1)" for k in range(8) for j in range(4)
)

ORACLE_SQL: dict[str, str] = {
    "op2_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_sort(list_distinct(list_transform(list_zip(w, w[2:], w[3:], w[4:], w[5:])[:len(w) - 4], lambda x: concat_ws(' ', x[1], x[2], x[3], x[4], x[5])))) END AS s FROM words),
        classes AS (SELECT s, min(doc_id) AS node, any_value(len(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
        shingles AS (SELECT node, n, unnest(s) AS shingle FROM classes),
        pairs AS (SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node < b.node
            GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach(node, seen) AS (SELECT node, node FROM classes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
        least AS (SELECT node, min(seen) AS least FROM reach GROUP BY node)
        SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(l.least, d.doc_id) AS component_id, d.doc_id = coalesce(l.least, d.doc_id) AS kept
        FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN least l ON l.node = c.node
    """,
    "op9_exact_dedup": """
        WITH h AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256 FROM h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op4_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(u, w) AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
        least AS (SELECT u, min(w) AS w FROM reach GROUP BY u),
        counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(w, vec_id)) AS component_id, vec_id <= coalesce(w, vec_id) AS kept
        FROM embeddings LEFT JOIN least ON least.u = vec_id LEFT JOIN counts ON counts.u = vec_id
    """,
    "op7_warc": f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS response FROM p)
        SELECT page_id, payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> response THEN response END AS refers_to FROM g
    """,
}
