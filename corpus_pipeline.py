"""From raw documents to token ids: five operators of ``typelore.llm`` one after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typelore.llm import bpe, minhash, mixing, quality_classifier, queries, secret_scan
from typelore.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones, by labels outside the held-out third."""
    labels = queries.table(spark, sf_dir, "labels")
    return quality_classifier.classify(docs, labels).filter("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; shingles of five words, similarity 0.8 and more.

    Documents are told apart by id and text, so a repeated id with another text stays if that text is no duplicate.
    """
    found = minhash.near_duplicates(docs, how=minhash.Similarity(k=5, percent=80))
    gone = found.filter(~F.col("kept")).select("doc_id", "text_hash").distinct()
    hashed = docs.withColumn("text_hash", F.xxhash64(F.col("text").cast("binary")))
    return hashed.join(cut_lineage(gone, "gone"), ["doc_id", "text_hash"], "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    cleaned = secret_scan.redact(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; those of sources short of their weight come up again."""
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, and the hash of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = docs.select("doc_id", "lang", "source", "text")
    # the stages before have filled the executors' memory already
    decoded = bpe.round_trip(texts, ranks, public_tokenizers.PATTERN, memory=0.4)
    return decoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs


#: SQL can express neither the fitted classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None
