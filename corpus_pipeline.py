"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The last returns the
packed pieces, the others the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import exact_dedup, packing, pii, quality, simhash
from tracelake.llm.common import mark, read_table, release, tokenizer_path, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays: the longest original, then the smallest doc_id."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies stays: the smallest doc_id."""
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms; every document stays."""
    return pii.pseudonymise(docs, pii.session_key(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 1024: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A learned classifier and a keyed permutation are not SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again. A stage's intermediates, and
    what the stage before it wrote, are deleted once it is written."""
    docs, begun = read_table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, begun, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
