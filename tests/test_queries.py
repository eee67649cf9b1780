"""Every registered query of the flow engine against its SQL, and the sequential ones against plain Python."""

import json
import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowlens.operators import anomaly, sessions, traffic
from flowlens.plans import catalog
from flowlens.sources import projections, tables
from flowlens.streaming import jobs
from flowlens.timerange import latest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in ("events", "nation", "supplier"):
        con.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = db.execute(catalog.ORACLE[name])
    columns, rows = [d[0] for d in cursor.description], cursor.fetchall()
    order = sorted(got.columns)
    assert order == sorted(columns)
    at = [columns.index(c) for c in order]
    assert plain(got.select(order).collect()) == plain([tuple(r[i] for i in at) for r in rows])


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE) <= set(entry.oracle_sql())


def test_lifetime_sessions(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = [(r.user_id, int(r.s)) for r in events.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).collect()]
    times = defaultdict(list)
    for user, s in sorted(rows):
        times[user].append(s)
    want = []
    for user, ts in times.items():
        parts = defaultdict(list)
        for t, n in zip(ts, sessions.split_sessions(ts, 12 * 3600, 48 * 3600), strict=True):
            parts[n].append(t)
        want += [(user, p[0], p[-1], len(p)) for p in parts.values()]
    got = catalog.QUERIES["sessions_lifetime"](spark, SF).select("user_id", "first_at", "last_at", "rows").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_behaviour_of_one_hot_device(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    flows = projections.flows_from_events(events, classified=False).withColumn("src_ip", F.lit("10.0.0.1"))
    flows = flows.withColumn("bytes_up", F.expr("if(event_id % 5 = 0, 0, bytes_up)")).withColumn("bytes_down", F.expr("if(event_id % 5 = 0, 0, bytes_down)"))
    got = {r.event_id: r for r in anomaly.features(flows, block=64).collect()}
    raw = sorted(flows.select("event_id", "timestamp", "sni", "dns_domain", "bytes_up", "bytes_down", "duration_ms").collect(), key=lambda r: (r.timestamp, r.event_id))
    assert len(got) == len(raw) > 200
    names, rates, hours = set(), [], {}
    for n, r in enumerate(raw):
        domain, rate = r.sni or r.dns_domain, (r.bytes_up + r.bytes_down) / max(r.duration_ms / 1000, 0.1)
        x = got[r.event_id]
        assert (x.n, x.known, x.is_new, x.hour_count) == (n, len(names), domain != "" and domain not in names, hours.get(r.timestamp.hour, 0))
        last = rates[-anomaly.SAMPLES :]
        assert x.mean_rate is None if not last else abs(x.mean_rate - sum(last) / len(last)) <= 1e-9 * x.mean_rate
        hours[r.timestamp.hour] = hours.get(r.timestamp.hour, 0) + 1
        if domain:
            names.add(domain)
        if rate > 0:
            rates.append(rate)


def test_cooldown(spark):
    rows = anomaly.scored(projections.flows_from_events(spark.read.parquet(f"{SF}/events.parquet"), classified=False))
    over = rows.where("risk_score >= 10").select("event_id", "timestamp", "src_ip", "reason").orderBy("timestamp", "event_id").collect()
    last, want = {}, []
    for r in over:
        key = r.src_ip, r.reason
        if key not in last or (r.timestamp - last[key]).total_seconds() >= anomaly.COOLDOWN_S:
            want.append(r.event_id)
            last[key] = r.timestamp
    assert sorted(r.event_id for r in anomaly.alerts(rows, 10).collect()) == sorted(want)


PACKETS = [
    # seq, seconds, from, to, ports, protocol, payload bytes, flags
    (1, 0.0, 1, 2, 1000, 443, 6, 100, 0), (2, 0.001, 2, 1, 443, 1000, 6, 1000, 0), (3, 5.0, 1, 2, 1000, 443, 6, 10, 1), (4, 6.0, 1, 2, 1000, 443, 6, 1, 0),
    (5, 0.5, 3, 2, 5000, 53, 17, 30, 0), (6, 30.0, 3, 2, 5000, 53, 17, 30, 0), *[(10 + i, 10.0 * i, 4, 2, 7, 80, 6, 50, 0) for i in range(9)],
]


def packets(spark, rows=PACKETS):
    ip = lambda n: bytearray([10, 0, 0, n])
    data = [(s, int((t + 1000) * 10**9), ip(a), ip(b), p, q, k, bytearray(n), bytearray(6), 0, f, 0) for s, t, a, b, p, q, k, n, f in rows]
    from flowlens.schema import PACKETS as schema

    return spark.createDataFrame(data, schema)


def test_flows_from_packets(spark):
    rows = sessions.flows_from_packets(packets(spark)).orderBy("src_ip", "first_seen").collect()
    got = [(r.src_ip, r.packets_up, r.packets_down, r.bytes_up, r.bytes_down, r.duration_ms) for r in rows]
    assert got == [("10.0.0.1", 2, 1, 110 + 148, 1074, 5000), ("10.0.0.1", 1, 0, 75, 0, 0), ("10.0.0.3", 1, 0, 104, 0, 0), ("10.0.0.3", 1, 0, 104, 0, 0), ("10.0.0.4", 7, 0, 7 * 124, 0, 60_000), ("10.0.0.4", 2, 0, 248, 0, 10_000)]
    assert list(rows[0].pkt_size_hist) == [0, 1, 1, 0, 0, 1, 0] and rows[0].pkt_iat_mean_us == pytest.approx((1000 + 4_999_000) / 2)


def test_flows_have_last_fields(spark):
    rows = packets(spark).withColumn("sni", F.when(F.col("seq") == 1, "a.example").when(F.col("seq") == 2, "b.example").otherwise(""))
    got = {(r.src_ip, r.first_seen): r.sni for r in sessions.flows_from_packets(rows, ("sni",)).collect()}
    assert sorted(v for v in got.values() if v) == ["b.example"] and len(got) == 6


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    late = (99, 4000.0, 9, 9, 1, 1, 17, 1, 0)  # moves the watermark past the last flow
    packets(spark).coalesce(1).write.parquet(path)
    packets(spark, [late]).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = jobs.flows(stream).writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    columns = ["src_ip", "first_seen", "last_seen", "packets_up", "packets_down", "bytes_up", "bytes_down", "duration_ms"]
    want = sessions.flows_from_packets(packets(spark)).select(columns).collect()
    assert sorted(tuple(r[c] for c in columns) for r in out if r.src_ip != "10.0.0.9") == sorted(map(tuple, want))


def test_stream_totals_and_alerts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    scored = anomaly.scored(projections.flows_from_events(events, classified=False)).where("risk_score >= 10").select("event_id", "timestamp", "src_ip", "src_mac", "risk_score", "reason")
    path = str(tmp_path / "alerts")
    scored.orderBy("timestamp").coalesce(1).write.parquet(path)
    out = []
    stream = spark.readStream.schema(scored.schema).parquet(path)
    query = jobs.cooled_alerts(stream).writeStream.foreachBatch(lambda b, i: out.extend(r.event_id for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(out) == sorted(r.event_id for r in anomaly.alerts(anomaly.scored(projections.flows_from_events(events, classified=False)), 10).collect())


def test_tables(spark, tmp_path):
    flows = projections.flows_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    path = str(tmp_path / "flows")
    tables.write_flows(flows, path)
    as_of = latest(flows)
    read = tables.read_flows(spark, path, as_of, "1d")
    assert read.count() == traffic.window(flows, as_of, "1d").count()
    assert "PartitionFilters: [isnotnull(yyyymm" in read._jdf.queryExecution().toString()
    tables.write_csv(traffic.csv_export(flows), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == flows.count()


def test_json_branches(spark, tmp_path):
    lines = [
        {"type": "flow_end", "timestamp": 1.5, "first_seen": 100, "last_seen": 103, "src_ip": "10.0.0.1", "tls_sni": "www.youtube.com", "dst_port": 443, "packets": 3, "bytes": 30},
        {"type": "device_info", "ip": "10.0.0.2", "vendor_class": "iPhone"}, {"type": "device_info", "ip": ""},
        {"type": "http_request", "host": "a.b", "path": "/" + "x" * 200}, {"type": "http_response", "host": "a.b", "path": "/" + "x" * 200, "status_code": 200}, {"type": "http_request", "host": "mitmproxy.org"},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    records = tables.read_json(spark, str(tmp_path))
    flow = tables.flow_records(records).first()
    assert (flow.app_name, flow.duration_ms, flow.packets_up, flow.bytes_down, flow.protocol) == ("YouTube", 3000, 3, 0, "TCP")
    assert [(r.ip, r.manufacturer) for r in tables.device_records(records).collect()] == [("10.0.0.2", "Apple")]
    assert sorted((r.type, len(r.path), r.status_code) for r in tables.session_records(records).collect()) == [("http_request", 128, 0), ("http_response", 64, 200)]
