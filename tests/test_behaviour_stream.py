"""Behaviour scores of a stream against the batch, over several micro-batches and a restart; remembered names."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import anomaly
from flowlens.sources import projections
from flowlens.streaming import behaviour

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocksdb(spark):
    for key, value in behaviour.ROCKSDB.items():
        spark.conf.set(key, value)
    yield spark
    for key in behaviour.ROCKSDB:
        spark.conf.unset(key)


def flows_of(spark):
    flows = projections.flows_from_events(spark.read.parquet(f"{SF}/events.parquet"), classified=False)
    # few devices with long histories
    return flows.withColumn("src_ip", F.concat(F.lit("10.0.0."), (F.col("event_id") % 3).cast("string")))


@pytest.mark.parametrize("memory", [None, 4])
def test_stream_equals_batch(rocksdb, tmp_path, memory):
    spark = rocksdb
    flows = flows_of(spark)
    rows = flows.orderBy("timestamp", "event_id").collect()
    path, out = str(tmp_path / "in"), []
    write = lambda part: spark.createDataFrame(part, flows.schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = behaviour.scored(stream, memory).writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()

    for at in range(0, 600, 200):
        write(rows[at : at + 200])
    run()
    write(rows[600:])
    run()  # a new query goes on from the states of the first
    want = {r.event_id: r for r in anomaly.scored(flows, memory=memory).collect()}
    assert len(out) == len(want) == len(rows)
    for r in out:
        w = want[r.event_id]
        assert (r.n, r.is_new, r.hour_count) == (w.n, w.is_new, w.hour_count) and (r.known == w.known or not r.domain)
        for part in ("novelty", "volume", "timing", "rate", "mean_rate"):
            if getattr(w, part) is not None:
                assert getattr(r, part) == pytest.approx(getattr(w, part), rel=1e-9)
        assert (r.risk_score, r.reason) == (w.risk_score, w.reason)
    assert max(r.n for r in out) > 200 and sum(r.risk_score > 0 for r in out) > 20


@pytest.mark.parametrize("memory", [1, 5, 9])
def test_remembered_names(spark, memory):
    flows = flows_of(spark)
    got = {r.event_id: (r.is_new, r.known) for r in anomaly.scored(flows, memory=memory).where("domain <> ''").collect()}
    names = {}
    for r in flows.orderBy("timestamp", "event_id").collect():
        name = r.sni or r.dns_domain
        if name:
            mine = names.setdefault(r.src_ip, [])
            assert got[r.event_id] == (name not in mine, len(mine)), (memory, r.event_id)
            if name not in mine:
                mine.append(name)
                del mine[: max(0, len(mine) - memory)]
    assert len(got) > 300
