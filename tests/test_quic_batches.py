"""QUIC packets go to Python in bounded batches, and only for keys and frames."""

from flowlens.functions import parsers
from flowlens.sources import payloads

SF = "/root/testdata/sf0.001"


def test_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        names = parsers.quic_names(payloads.quic_initials(spark.read.parquet(f"{SF}/events.parquet").limit(20)))
        assert int(spark.conf.get(name)) == parsers.BATCH_ROWS
        assert names._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
        assert sum(r.quic_sni is not None for r in names.collect()) == 18
    finally:
        spark.conf.set(name, before)
