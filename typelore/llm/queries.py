"""One query per operator over the whole of its table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typelore.llm import (
    bpe,
    language_id,
    minhash,
    mixing,
    multi_index,
    prefix_trie,
    quality_classifier,
    quality_rules,
    secret_scan,
    substrings,
    toxicity,
    url_filter,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.round_trip(texts, ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "is_utf8",
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), how=minhash.Similarity(k=3, percent=85))


def rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return entries.select(
        "doc_id",
        *[F.col(f"measures.{c}").alias(c) for c in counts],
        (~quality_rules.passes(quality_rules.POLICIES["base"])).alias("base_failed"),
        quality_rules.passes(quality_rules.POLICIES["2"]).alias("kept"),
        "failed",
    )


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", *secret_scan.digest(scanned))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.classify(docs.select("doc_id", "text"), labels).drop("text")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.classify(docs.select("doc_id", "text"), labels).drop("text")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


#: The tables hold no lists and no fetch times: both follow from the pages, by the same rules here and in the SQL.
CAPTURED = "date_add(DATE '2024-01-01', CAST(page_id * 37 % 366 AS INT)) AS fetched"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", CAPTURED)


def list_events(pages: DataFrame) -> DataFrame:
    """Dated list entries: some hosts come, go and come back; some sections of hosts are listed for good."""
    host, section = url_filter.host_of(F.col("url")), F.regexp_extract("url", "^[^/]*//[^/]*/([^/?#]+)", 1)
    hosts = pages.select(host.alias("pattern")).filter("pattern IS NOT NULL").distinct()
    sections = pages.select(F.concat(host, F.lit("/"), section).alias("pattern")).filter(section != "").distinct()

    def dated(patterns: DataFrame, day: str, action: str, where: str) -> DataFrame:
        hashed = patterns.withColumn("x", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long"))
        return hashed.filter(where).selectExpr(
            "pattern", f"date_add(DATE '2024-01-01', CAST({day} AS INT)) AS at", f"'{action}' AS action"
        )

    return (
        dated(hosts, "x % 200", "add", "x % 3 = 0")
        .union(dated(hosts, "x % 200 + 60", "remove", "x % 6 = 0"))
        .union(dated(hosts, "x % 200 + 120", "add", "x % 12 = 0"))
        .union(dated(sections, "x % 300", "add", "x % 5 = 0"))
    )


def checked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = captures(spark, sf_dir)
    return url_filter.check(fetched, url_filter.intervals(list_events(fetched)))


CHECKED_URLS = """
WITH c AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS DATE) AS fetched,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
    regexp_extract(url, '^[^/]*//[^/]*/([^/?#]+)', 1) AS section
  FROM pages
), h AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS x
  FROM (SELECT DISTINCT host AS pattern FROM c WHERE host IS NOT NULL) d
), s AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS x
  FROM (SELECT DISTINCT host || '/' || section AS pattern FROM c WHERE host IS NOT NULL AND section <> '') d
), e AS (
  SELECT pattern, x % 200 AS day, TRUE AS added FROM h WHERE x % 3 = 0
  UNION ALL SELECT pattern, x % 200 + 60, FALSE FROM h WHERE x % 6 = 0
  UNION ALL SELECT pattern, x % 200 + 120, TRUE FROM h WHERE x % 12 = 0
  UNION ALL SELECT pattern, x % 300, TRUE FROM s WHERE x % 5 = 0
), v AS (
  SELECT pattern, DATE '2024-01-01' + CAST(day AS INT) AS valid_from,
    DATE '2024-01-01' + CAST(lead(day) OVER (PARTITION BY pattern ORDER BY day) AS INT) AS valid_to, added
  FROM e
), m AS (
  SELECT c.page_id, v.pattern, CAST(v.valid_from AS DATE) AS valid_from,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.pattern) DESC, v.pattern DESC) AS best
  FROM c JOIN v ON v.added AND c.fetched >= v.valid_from AND (v.valid_to IS NULL OR c.fetched < v.valid_to)
    AND (c.host = split_part(v.pattern, '/', 1) OR c.host LIKE '%.' || split_part(v.pattern, '/', 1))
    AND (v.pattern NOT LIKE '%/%' OR c.section = split_part(v.pattern, '/', 2))
)
SELECT c.page_id, c.url, c.fetched, m.pattern IS NOT NULL AS blocked, m.pattern, m.valid_from
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.best = 1
"""

def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def language_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


#: Nodes by their list of turns; crc32 of the decimal id bit by bit, since the dialect has no function for it.
CONVERSATION_TRIE = """
WITH RECURSIVE r AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), lens AS (
  SELECT c, max(p) AS n FROM r GROUP BY c
), crc(c, k, v) AS (
  SELECT c, 0, CAST(4294967295 AS BIGINT) FROM lens
  UNION ALL
  SELECT c, k + 1,
    CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(CAST(c AS VARCHAR), k // 8 + 1, 1))) ELSE v END) & 1 = 1
      THEN xor((CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(CAST(c AS VARCHAR), k // 8 + 1, 1))) ELSE v END) >> 1, 3988292384)
      ELSE (CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(CAST(c AS VARCHAR), k // 8 + 1, 1))) ELSE v END) >> 1 END
  FROM crc WHERE k < 8 * length(CAST(c AS VARCHAR))
), cv AS (
  SELECT l.c, l.n, xor(crc.v, 4294967295) % 9 AS h, least(xor(crc.v, 4294967295) % 9, coalesce(b.n, 0)) AS hk
  FROM lens l JOIN crc ON crc.c = l.c AND crc.k = 8 * length(CAST(l.c AS VARCHAR))
  LEFT JOIN lens b ON b.c = l.c - l.c % 5
), rt AS (
  SELECT cv.c, r.p AS d, r.role, r.text FROM cv JOIN r ON r.c = cv.c - cv.c % 5 AND r.p <= cv.hk
  UNION ALL
  SELECT cv.c, cv.hk + r.p - cv.h AS d, r.role, r.text FROM cv JOIN r ON r.c = cv.c AND r.p > cv.h
), sizes AS (
  SELECT c, hk + greatest(0, n - h) AS len FROM cv
), m AS (
  SELECT c, 0 AS d, CAST([] AS STRUCT(role VARCHAR, text VARCHAR)[]) AS key, 0 AS bytes FROM sizes
  UNION ALL
  SELECT c, d, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    octet_length(encode(text)) FROM rt
), mm AS (
  SELECT m.*, lead(key) OVER (PARTITION BY c ORDER BY d) AS next_key, s.len FROM m JOIN sizes s USING (c)
), nodes AS (
  SELECT d, key, count(*) AS n_convs, min(c) AS conv_id, count(DISTINCT next_key) AS n_children, max(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len = d), '')) AS ends_sha256
  FROM mm GROUP BY d, key
), sub AS (
  SELECT x.d, x.key, sum((y.n_convs - 1) * y.bytes) AS saved_tokens, sum(CASE WHEN y.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM mm x JOIN nodes y ON y.conv_id = x.c AND y.d >= x.d
  GROUP BY x.d, x.key
)
SELECT nodes.conv_id, nodes.d AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs, nodes.n_children,
  sub.n_leaves, sub.saved_tokens, nodes.ends_sha256
FROM nodes JOIN sub ON sub.d = nodes.d AND sub.key = nodes.key
LEFT JOIN nodes parent ON parent.d = nodes.d - 1 AND parent.key = list_slice(nodes.key, 1, nodes.d - 1)
"""


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": near_duplicates,
    "op2_nearest_vectors": nearest_vectors,
    "op3_bpe_round_trip": bpe_round_trip,
    "op4_rule_ledger": rule_ledger,
    "op5_repeated_passages": repeated_passages,
    "op6_secret_spans": secret_spans,
    "op7_checked_urls": checked_urls,
    "op8_mixed_sources": mixed_sources,
    "op9_quality_scores": quality_scores,
    "op10_toxicity_scores": toxicity_scores,
    "op11_whitened_embeddings": whitened_embeddings,
    "op12_conversation_trie": conversation_trie,
    "op13_language_ids": language_ids,
}

ORACLE: dict[str, str] = {
    "op7_checked_urls": CHECKED_URLS,
    "op12_conversation_trie": CONVERSATION_TRIE,
}
