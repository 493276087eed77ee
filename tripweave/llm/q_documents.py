"""Queries on the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, lm, passages, quality, simhash, suffixes
from .common import table
from .registry import query


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.cut_repeats(docs, 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_compact_windows")
def op2_compact_windows(spark, sf_dir):
    return passages.near_passages(table(spark, sf_dir, "documents"))


@query("op6_lm_scoring")
def op6_lm_scoring(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm.score(table(spark, sf_dir, "documents"), good)
