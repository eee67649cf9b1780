"""Sessions of many small keys: no Python call for each, no payload parsed twice."""

import random

from flowlens.operators import anomaly, layers, sessions
from flowlens.sources import payloads

SF = "/root/testdata/sf0.001"


def test_sessions_of_many_keys(spark):
    rng, rows = random.Random(7), []
    for key in [None, *[f"k{i}" for i in range(300)]]:
        rows += [(key, key and len(key), t) for t in (rng.choice((0, -5000, 90_000)) + rng.randrange(400) for _ in range(rng.randrange(1, 30)))]
    frame = spark.createDataFrame(rows, "a string, b int, at long")
    got = {(r.a, r.at) for r in sessions.session_starts(frame, ["a", "b"], "at", 9, 30, 64).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        times = sorted({r[2] for r in rows if r[0] == key})
        numbers = sessions.split_sessions(times, 9, 30)
        want |= {(key, t) for i, t in enumerate(times) if i == 0 or numbers[i] != numbers[i - 1]}
    assert got == want


def test_no_call_for_each_key(spark):
    frame = spark.range(50).selectExpr("id % 7 as key", "id * id as at")
    plan = sessions.session_starts(frame, ["key"], "at", 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_payloads_are_parsed_once(spark):
    packets = payloads.packets(spark.read.parquet(f"{SF}/events.parquet"))
    flows = sessions.flows_from_packets(layers.fields(packets), ("sni", "ja3"))
    plan = flows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_alerts_need_no_call_for_each_key(spark):
    rows = spark.range(40).selectExpr("id as event_id", "timestamp_seconds(id * 100) as timestamp", "concat('d', id % 2) as src_ip", "'m' as src_mac", "60 as risk_score", "'r' as reason")
    kept = anomaly.alerts(rows)
    assert "FlatMapGroups" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.event_id for r in kept.collect()) == [i for i in range(40) if i % 4 < 2]
