"""The corpus pipeline: quality, exact dedup, near-dedup, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaymark.llm import exact_dedup, mixing, near_dedup, packing, quality
from quaymark.llm.common import materialize, read_table

#: Each takes (spark, docs, sf_dir); its result is written and read again for the next one.
STAGES = [
    ("quality_classifier", quality.quality_stage),
    ("exact_dedup", exact_dedup.exact_stage),
    ("near_dedup", near_dedup.near_stage),
    ("mixing", mixing.mixing_stage),
    ("packing", packing.packing_stage),
]

#: SQL cannot express the classifier, the sketches or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
