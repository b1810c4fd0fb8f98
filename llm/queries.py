"""The registered query of each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import encode_documents
from llm.common import shared_folder, table
from llm.fingerprint_blocks import document_fingerprints
from llm.license_join import license_scan
from llm.mixing import mix_counts
from llm.pii import surrogates
from llm.prefix_trie import prefix_trie
from llm.projected_ann import nearest
from llm.secret_spans import secret_spans
from llm.simhash_variants import near_duplicates
from llm.toxicity import toxicity
from llm.url_alias import judge
from llm.warc import archive_round_trip
from llm.whitening import whitened

#: A secret in production; here it only has to be the same on every run.
SURROGATE_KEY = b"example key"

#: Host, path and verdict of the URL rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_counts(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op3_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates(table(spark, folder, "documents"), SURROGATE_KEY)


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), words=3, radius=2)


def op5_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op6_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return document_fingerprints(table(spark, folder, "documents"))


def op7_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_spans(table(spark, folder, "documents"))


def op8_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return archive_round_trip(table(spark, folder, "pages"), shared_folder(spark, "warc"))


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(table(spark, folder, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op10_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op11_whitened_components(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitened(table(spark, folder, "embeddings"), components=32)
    return rows.withColumn("deviation", F.col("deviation").cast("bigint"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_nearest_vectors": op5_nearest_vectors,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_secret_spans": op7_secret_spans,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_url_verdicts": op10_url_verdicts,
    "op11_whitened_components": op11_whitened_components,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_license_scan": op13_license_scan,
}
