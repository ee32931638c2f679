"""One query for each operator over its whole table, in the form of its contract, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oracles
from tidemark.llm.common import table
from tidemark.llm.decontam import contamination
from tidemark.llm.langid import language_digests
from tidemark.llm.packing import packed_documents
from tidemark.llm.parity_join import jaccard_components
from tidemark.llm.pii import configured_key, pseudonymised
from tidemark.llm.sharding import sharded
from tidemark.llm.token_planes import token_digests
from tidemark.llm.topk import top_k
from tidemark.llm.url_filter import judged
from tidemark.llm.warc import round_trip

#: The urls' rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("allow", "com/fr/"), ("block", "example.org/en/1"), ("block", "com/de/"))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url, by rules and by path templates."""
    return judged(table(spark, sf_dir, "pages"), RULES)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of the benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13, share=20).drop("mark")


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with keyed pseudonyms for validated numbers and dates."""
    found = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), configured_key(spark))
    return found.select("doc_id", "text", F.size("__kinds").cast("long").alias("n_pseudonyms"), F.array_join("__kinds", ",").alias("kinds"))


def op5_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document in bit-plane files, read back."""
    return token_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return language_digests(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back."""
    return round_trip(spark, table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a 3-word shingle Jaccard similarity of 0.9."""
    found = jaccard_components(table(spark, sf_dir, "documents"), ngram=3, p=90, q=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24, by virtual slots balanced in bytes."""
    return sharded(table(spark, sf_dir, "documents"), shards=24)


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_url_filter, op3_decontamination, op4_pii_pseudonyms, op5_bit_plane_tokens, op6_language_id, op7_warc, op8_best_fit_packing, op9_ngram_jaccard_join, op10_virtual_slots)}

ORACLE: dict[str, str] = {
    "op1_exact_topk": oracles.TOPK,
    "op2_url_filter": oracles.url_filter(RULES),
    "op3_decontamination": oracles.DECONTAMINATION,
    "op7_warc": oracles.WARC,
    "op9_ngram_jaccard_join": oracles.JACCARD,
    "op10_virtual_slots": oracles.SHARDING,
}
