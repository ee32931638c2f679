"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns rows.

All but the last return the columns of documents. Each stage's rows are written and read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, packing, parity_join, pii
from tidemark.llm.common import stored, table
from tidemark.session import ready


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is less than even, go."""
    ready(spark)
    return langid.keep_identified(docs, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a Jaccard similarity of 0.8 or more, that of the smallest doc_id stays."""
    ready(spark)
    return parity_join.keep_one(docs, ngram=5, p=80, q=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in 13-word windows of the benchmark go."""
    ready(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), n=13, share=20)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers and dates become keyed pseudonyms; every document stays."""
    ready(spark)
    found = pii.pseudonymised(docs, pii.configured_key(spark))
    return found.drop(found.columns[-1])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens: a row for each piece of a document."""
    ready(spark)
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii_pseudonyms", pseudonyms),
    ("best_fit_packing", pack),
]

#: A trained classifier and a tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
