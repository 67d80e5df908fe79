"""Registered queries of this subpackage: a thin digest of each operator's result over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import alignment, bpe, exact_topk, hnsw, html_text, near_dup, packing, quality, simhash, spelling, suffix_dedup, url_filter, warc
from textloom.llm.shared import table

# Fixed values of the contract: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packing.pack(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe.digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(exact_topk.chosen(rows, "vec_id", 100), hnsw.index(rows, keep=11), 10)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(exact_topk.chosen(rows, "vec_id", 50), rows, 5, 256.0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    found = quality.score(documents, model)
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return alignment.summed(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_bpe": op3_bpe,
    "op4_hnsw": op4_hnsw,
    "op5_exact_topk": op5_exact_topk,
    "op6_quality": op6_quality,
    "op7_near_dup": op7_near_dup,
    "op8_html_text": op8_html_text,
    "op9_url_filter": op9_url_filter,
    "op10_warc": op10_warc,
    "op11_simhash": op11_simhash,
    "op12_alignment": op12_alignment,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(generate_series(1, len(q.w)), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.w) = len(q.w)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
    """,
    "op9_url_filter": """
        WITH rules(verdict, rule_host, rule_path) AS (VALUES
            ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
            ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), rests AS (
            SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
        ), distinct_parts AS (SELECT DISTINCT host, path FROM parts),
        fits AS (
            SELECT host, path, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS n
            FROM distinct_parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path AND f.n = 1
    """,
    "op10_warc": """
        WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
        tops AS (SELECT digest, max(page_id) AS top, count(*) AS n FROM d GROUP BY digest),
        b AS (
            SELECT d.*, t.top, t.n, array_to_string(list_transform(generate_series(0, 31), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + CAST(list_sum(list_transform(generate_series(0, 4), lambda b:
                           CASE WHEN (instr('0123456789abcdef', substr(d.digest, 1 + CAST((5 * i + b) // 4 AS INTEGER), 1)) - 1) & (8 >> CAST((5 * i + b) % 4 AS INTEGER)) > 0
                                THEN 16 >> CAST(b AS INTEGER) ELSE 0 END)) AS INTEGER), 1)), '') AS base32
            FROM d JOIN tops t ON d.digest = t.digest
        )
        SELECT page_id, octet_length(payload) AS payload_bytes, base32 AS payload_digest,
               CASE WHEN n > 1 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n > 1 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
        FROM b
    """,
}
