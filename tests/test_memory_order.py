"""A bounded name memory where the join before it is planned as shuffled on the device, so that Spark might leave out a repartition by it."""

from pyspark.sql import functions as F

from flowlens.operators import anomaly

CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "5"}


def test_devices_stay_whole(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        n = 3000
        i = F.col("id")
        name = F.pmod(F.xxhash64("id"), F.lit(9))
        flows = spark.range(0, n, 1, 6).select(
            i.alias("event_id"), F.timestamp_seconds(i * 60).cast("timestamp_ntz").alias("timestamp"), F.concat(F.lit("10.0.0."), (i % 4).cast("string")).alias("src_ip"),
            F.concat(F.lit("n"), name.cast("string")).alias("sni"), F.lit("").alias("dns_domain"),
        )
        rows = {r.event_id: r for r in flows.collect()}
        found = anomaly.remembered(flows, 5)
        got = {r.event_id: r.is_new for r in found.collect()}
        # what the join's shuffle is read by may change, a repartition of its own may not
        assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
        memory: dict[str, list[str]] = {}
        want = {}
        for e in sorted(rows):
            names = memory.setdefault(rows[e].src_ip, [])
            want[e] = rows[e].sni not in names
            if want[e]:
                memory[rows[e].src_ip] = [*names, rows[e].sni][-5:]
        assert got == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
