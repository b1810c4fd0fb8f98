"""The corpus pipeline: STAGES in order, each over what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import encode_documents
from llm.common import ref, saved, table, unused
from llm.components import components
from llm.mixing import mixed
from llm.pii import replaced
from llm.queries import SURROGATE_KEY
from llm.simhash_variants import fingerprints, near_links
from llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models trained on ``labels`` do not call toxic, with all their columns.

    The text alone decides, so copies share their fate; null and empty texts are judged like a text without any known word. Null and repeated
    ids and other columns make no difference. An empty table stays empty; without labels no document is toxic.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies one row: that with the smallest id, null ids last, and of rows with one id that with the smallest digest.

    Groups are those of the fingerprints, so rows with a null id, or with one id and different texts, are told apart by their texts. The
    digest covers all columns; rows alike in all of them are one document. Null, empty and blank texts are one group: fingerprint zero. An empty
    table stays empty.
    """
    cells = [ref(c) for c in docs.columns]
    marked = [*cells, *[F.isnull(c) for c in cells]]  # hashes alone pass over nulls
    digest = F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit(1), *marked).alias("b"))
    found = docs.select(fingerprints(ref("text").cast("string"), 3).alias("fp"), ref("doc_id").cast("long").alias("id"), digest.alias("digest"))
    units = saved(found.groupBy("fp", "id", "digest").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.isnull("id").alias("last"), "id", "digest", "n")
    prints = saved(units.groupBy("fp").agg(F.min(order).alias("least")))
    roots = components(near_links(prints, 2))
    groups = prints.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("least").alias("least"))
    kept_id, kept_digest, count = (unused(docs, c) for c in ("kept_id", "kept_digest", "kept_rows"))
    chosen = groups.select(F.col("least.id").alias(kept_id), F.col("least.digest").alias(kept_digest), F.col("least.n").alias(count))
    kept = saved(chosen)

    def rows(which: Column) -> DataFrame:
        same = ref("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (digest == F.col(kept_digest))
        return docs.join(kept.where(which), same, "left_semi")

    several = F.col(count) > 1
    if kept.where(several).isEmpty():
        return rows(~several)
    return rows(~several).unionByName(rows(several).dropDuplicates())


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates instead of personal data; ``n_chars`` follows the new text.

    Null texts stay null, empty ones and those without personal data as they are. Every row is kept, repeated rows alike; other columns
    are not touched. An empty table stays empty.
    """
    return replaced(docs, SURROGATE_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice is two rows.

    Null, empty and blank texts have no words and are not taken; a null source is a source of its own; rows with one id, alike or
    not, are documents of their own. An empty table stays empty.
    """
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests of ids and decoded bytes.

    A row per row, ids null or repeated as they are; null and empty texts have no tokens. Other columns are not kept. An empty table stays
    empty.
    """
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("drop_toxic", drop_toxic),
    ("drop_near_copies", drop_near_copies),
    ("replace_personal_data", replace_personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Training a classifier, keyed surrogates and merge replay have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is saved in the shared checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = saved(docs)
    return docs
