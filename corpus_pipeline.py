"""A training-corpus pipeline over the document table: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripweave.llm import decontaminate, mixing, q_mixing, quality, simhash, suffixes
from tripweave.llm.common import table
from tripweave.session import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels of the held-out fold are not used."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest doc_id (3-word shingles, 3 bits)."""
    return simhash.keep_one(docs, width=3, radius=3)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings; n_chars follows."""
    return suffixes.clean_texts(docs, 200)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, copied or edited."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their number of whole epochs and the tokens taken in the last one."""
    return mixing.mix(docs, q_mixing.domain(), q_mixing.WEIGHTS, q_mixing.SHARE, q_mixing.EPOCHS, q_mixing.SEED)


STAGES = [
    ("quality_classifier", good_documents),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark_leaks),
    ("mixing", mixture),
]

# The stages learn a model, link fingerprints and sort suffixes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
