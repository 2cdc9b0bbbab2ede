"""The registered queries: each operator over its whole table, by its production
parameters, and the results that its contract asks for."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    byte_pairs,
    chat,
    chunked,
    divergence,
    hard_negatives,
    host_rules,
    packing,
    simhash,
    token_counts,
    token_store,
    top_k,
    toxicity,
    urls,
    warc,
)
from shelfwise.sources.scratch import cut_lineage, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

#: URL rules, the toxicity chain's categories, and the sizes of the contracts.
URL_RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
CATEGORIES = ("low_quality", "toxic")
STORE_END_ID, PACK_END_ID, SEQUENCE = 2, 1, 2048
#: Characters that the store's and the packing's tasks encode at a time.
ENCODED = 4 << 20
VECTOR_SCALE, BEST, QUERY_STEP = 256, 5, 50
ANCHOR_STEP, RELABEL_STEP, LABELS, SCORE_SHARES = 100, 7, 10, (80, 100)


PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


def find_package(spark: SparkSession) -> None:
    """Let local Python workers import this package from where the driver did.

    On a cluster the package is installed, or sent along with ``--py-files``.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])


def _registered(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        find_package(spark)
        return query(spark, sf_dir)

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_tokenizer() -> chunked.BatchEncoder:
    """The store's tokenizer file as loaded, its added tokens included.

    Each task builds one and drops it with the pieces it has met: an executor keeps several
    idle workers, and all of them would hold one.
    """
    loaded = chunked.load(public_tokenizers.path("word_bpe_49k.json"))
    return chunked.BatchEncoder(chunked.AddedTokens(chunked.lower_case_encoder(loaded), loaded))


def pack_tokenizer() -> chunked.BatchEncoder:
    """The packing's tokenizer file as loaded, its added tokens included."""
    loaded = chunked.load(public_tokenizers.path("byte_bpe_50k.json"))
    return chunked.BatchEncoder(chunked.AddedTokens(chunked.byte_level_encoder(loaded, public_tokenizers.PATTERN), loaded))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_store")
    token_store.write_token_store(_table(spark, sf_dir, "documents"), path, store_tokenizer, STORE_END_ID, ENCODED)
    return token_store.read_token_store(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(spark, manifest).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], conversations.schema)
    examples = chat.expand(conversations.union(added))
    return chat.summarise(cut_lineage(examples, "examples"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0), BEST, VECTOR_SCALE)


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_table(spark, sf_dir, "documents"))


def op6_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_pairs.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_pairs.digests(encoded, ranks)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(_table(spark, sf_dir, "documents"), pack_tokenizer, PACK_END_ID, SEQUENCE, most_characters=ENCODED)
    return packing.pack(pieces, SEQUENCE)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def chain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as the chain's categories: quality turned round, then toxic."""
    labels = _table(spark, sf_dir, "labels")
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge(_table(spark, sf_dir, "documents"), chain_labels(spark, sf_dir), CATEGORIES)
    return judged.select(
        "doc_id",
        F.col("toxicity.low_quality").alias("low_quality_probability"),
        F.col("toxicity.toxic").alias("toxic_probability"),
        (F.col("toxicity.toxic") > toxicity.LIMIT).alias("toxic"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by ``RELABEL_STEP`` move on by one first, as wrong labels do."""
    moved = (F.col("label") + 1) % LABELS
    label = F.when(F.col("vec_id") % RELABEL_STEP == 0, moved).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    anchors = vectors.where(F.col("vec_id") % ANCHOR_STEP == 0)
    return hard_negatives.mine(vectors, anchors, VECTOR_SCALE, BEST, BEST, *SCORE_SHARES)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES: dict[str, Query] = {
    f.__name__: _registered(f)
    for f in (
        op1_token_store,
        op2_warc,
        op3_chat,
        op4_top_k,
        op5_host_rules,
        op6_byte_pairs,
        op7_packing,
        op8_simhash,
        op9_urls,
        op10_toxicity,
        op11_hard_negatives,
        op12_divergence,
        op13_token_counts,
        pipeline,
    )
}
