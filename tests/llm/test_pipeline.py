"""The pipeline: what each stage rejects, and the rows of the whole."""

import corpus_pipeline
from flowlens.llm import jaccard_join, quality_rules
from flowlens.llm._shared import written

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "jaccard_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in quality_rules.op3_quality_rules(spark, SF).where("kept").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "jaccard_dedup":
            kept = {r.component_id for r in jaccard_join.jaccard_components(before).collect()}
        assert ids == kept, name
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
