"""The corpus pipeline: documents through quality rules, language identification, deduplication and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import best_fit_packing, jaccard_join, language_id, quality_rules
from flowlens.llm._shared import read_table, scratch, written

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.quality_kept),
    ("language_id", language_id.language_kept),
    ("jaccard_dedup", jaccard_join.one_of_each),
    ("best_fit_packing", best_fit_packing.packed_stage),
]

#: Robust estimates, learned profiles, token ids and packing have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # a stage's own tables go once its result is written
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, outlive=True)
    return docs
