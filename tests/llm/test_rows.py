"""The dedup stage by rows: repeated ids, ids on several texts, and rows without an id."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import jaccard_join

SCHEMA = "doc_id long, text string, id string, doc string"
A, B, C = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")


def test_one_row_of_each(spark):
    stage = dict(corpus_pipeline.STAGES)["jaccard_dedup"]
    rows = [(6, A, "x", "y"), (6, A, "x", "y"), (None, A, "x", "y"), (None, "", "x", "y"), (1, B, "x", "y"), (7, B + " tail", "x", "y"), (7, C, "x", "y"), (9, C, "x", "y"), (None, "alone here", None, None), (None, "alone here", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.schema == docs.schema
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == collections.Counter([(6, A), (None, ""), (1, B), (7, C), (None, "alone here")])


def test_table_taken_in_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") > 60)
    once = jaccard_join.one_of_each(spark, docs, "")
    twice = jaccard_join.one_of_each(spark, docs.union(docs), "")
    assert sorted(r.doc_id for r in twice.collect()) == sorted(r.doc_id for r in once.collect())
