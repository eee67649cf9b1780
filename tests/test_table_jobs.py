"""Table jobs: versions merged into the months they touch, expiry by months, branches of JSON lines, sketches, networks."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowlens.functions import classify, net
from flowlens.operators import traffic
from flowlens.sources import tables
from flowlens.streaming import jobs

SCHEMA = "timestamp timestamp_ntz, src_ip string, first_seen long, last_seen long, note string"


def rows_of(spark, path):
    return sorted((str(r.timestamp), r.src_ip, r.first_seen, r.last_seen, r.note) for r in spark.read.parquet(path).collect())


def files(path, month):
    folder = os.path.join(path, f"yyyymm={month}")
    return {f: os.stat(os.path.join(folder, f)).st_mtime_ns for f in os.listdir(folder) if f.endswith(".parquet")}


def test_merged_versions(spark, tmp_path):
    path = str(tmp_path / "flows")
    day = lambda month, d: datetime(2024, month, d)
    batches = {
        "b1": [(day(1, 5), "a", 1, 10, "old"), (day(2, 5), "a", 1, 10, "kept"), (day(2, 6), "b", 1, 5, "late loses")],
        "b2": [(day(1, 5), "a", 1, 20, "new"), (day(1, 5), "a", 2, 1, "other flow")],
        "b3": [(day(2, 6), "b", 1, 3, "older version, later batch"), (day(3, 1), None, 1, 1, "no address")],
    }
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert tables.merge_flows(frame(batches["b1"]), path, "b1")
    before = files(path, 202402)
    assert tables.merge_flows(frame(batches["b2"]), path, "b2")
    assert files(path, 202402) == before  # a month that the batch doesn't touch keeps its files
    assert not tables.merge_flows(frame(batches["b1"]), path, "b1")
    assert tables.merge_flows(frame(batches["b3"]), path, "b3") and tables.merge_flows(frame([]), path, "b4")
    got = rows_of(spark, path)
    want = traffic.latest_version(frame(sum(batches.values(), [])))
    assert got == sorted((str(r.timestamp), r.src_ip, r.first_seen, r.last_seen, r.note) for r in want.collect())
    # a replay of a batch whose mark was lost changes nothing
    os.remove(os.path.join(path, "_merged", "b2"))
    assert tables.merge_flows(frame(batches["b2"]), path, "b2") and rows_of(spark, path) == got
    assert tables.merged_batches(spark, path) == {"b1", "b2", "b3", "b4"} and tables.months(spark, path) == [202401, 202402, 202403]


def test_expiry(spark, tmp_path):
    path = str(tmp_path / "flows")
    rows = [(datetime(2024, m, d), "a", 1, 1, "") for m in (1, 2, 3, 4) for d in (1, 10, 20)]
    tables.write_flows(spark.createDataFrame(rows, SCHEMA), path)
    april = files(path, 202404)
    as_of = datetime(2024, 4, 21)
    assert tables.expire(spark, path, as_of, 40) == ([202401, 202402], 202403)  # from the 12th of March
    assert tables.months(spark, path) == [202403, 202404] and files(path, 202404) == april
    assert [r[0][:10] for r in rows_of(spark, path)] == ["2024-03-20", "2024-04-01", "2024-04-10", "2024-04-20"]
    assert tables.expire(spark, path, as_of, 40) == ([], None)
    assert tables.expire(spark, path, as_of + timedelta(days=15), 40) == ([], 202403)  # all of March is too old by then
    assert tables.months(spark, path) == [202404]
    assert tables.expire(spark, str(tmp_path / "none"), as_of) == ([], None)


def test_branches_are_written_once(spark, tmp_path):
    lines = [json.dumps(x) for x in ({"type": "flow_end", "src_ip": "10.0.0.1", "packets": 3}, {"type": "device_info", "ip": "10.0.0.2"}, {"type": "http_request", "host": "a.b"}, {"type": "keepalive"})] + ["not json", "", "[1, 2", '{"type": 5, "packets": "x"}']
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(source)
    stream = spark.readStream.text(source)
    real, failed = jobs.BRANCHES["sessions"], []

    def once(records):
        if not failed:
            failed.append(True)
            raise RuntimeError("between two tables")
        return real(records)

    jobs.BRANCHES["sessions"] = once
    try:
        with pytest.raises(Exception, match="between two tables"):
            jobs.fan_out(stream, path, checkpoint).awaitTermination()
        jobs.fan_out(stream, path, checkpoint).awaitTermination()
    finally:
        jobs.BRANCHES["sessions"] = real
    spark.createDataFrame([(json.dumps({"type": "device_info", "ip": "10.0.0.3"}),)], "value string").coalesce(1).write.mode("append").text(source)
    jobs.fan_out(stream, path, checkpoint).awaitTermination()
    count = lambda name: jobs.read_branch(spark, path, name).count()
    assert (count("flows"), count("devices"), count("sessions")) == (1, 2, 1)
    assert sorted(r.value for r in jobs.read_branch(spark, path, "quarantine").collect()) == sorted(["not json", "[1, 2", lines[-1]])


def test_rollup_parts(spark):
    flows = spark.range(60_000).select(F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("timestamp"), F.lit(1).alias("app_id"), F.lit("a").alias("app_name"), F.lit("c").alias("app_category"), F.col("id").alias("bytes_up"), F.lit(1).alias("bytes_down"), F.concat(F.lit("10."), F.col("id") % 20_000).alias("src_ip"), "id")
    parts = [traffic.rollup_part(flows.where(F.col("id") % 6 == i)) for i in range(6)]
    stored = traffic.rollup_merged(parts[0].unionByName(parts[1]))
    for part in parts[2:]:
        stored = traffic.rollup_merged(stored.unionByName(part))
    got, whole = traffic.rollup_read(stored).first(), traffic.rollup_read(traffic.rollup_part(flows)).first()
    assert (got.flow_count, got.total_bytes) == (whole.flow_count, whole.total_bytes) == (60_000, sum(range(60_000)) + 60_000)
    # four standard deviations
    bound = 4 * 1.04 / 2 ** (traffic.SKETCH_BITS / 2) * 20_000
    assert abs(got.unique_devices - 20_000) <= bound and abs(whole.unique_devices - 20_000) <= bound


def test_networks(spark):
    networks = spark.createDataFrame([("10.0.0.0/8", "ten"), ("10.1.0.0/16", "ten one"), ("10.1.2.128/25", "small"), ("10.1.2.3/32", "host"), ("0.0.0.0/0", "all"), ("2001:db8::/32", "v6"), ("2001:db8:0:1::/64", "v6 net"), ("bad/8", "bad"), ("10.0.0.0/99", "bad"), ("10.1.0.0/16", "a second")], "cidr string, place string")
    rows = spark.createDataFrame([("10.9.9.9",), ("10.1.2.3",), ("10.1.2.200",), ("10.1.9.9",), ("8.8.8.8",), ("2001:db8::1",), ("2001:db8:0:1::9",), ("2001:db9::1",), ("x",), (None,), ("10.1.2.3",)], "ip string")
    got = sorted(((r.ip or "", r.place) for r in traffic.network_of(rows, networks).collect()))
    want = [("", None), ("10.1.2.200", "small"), ("10.1.2.3", "host"), ("10.1.2.3", "host"), ("10.1.9.9", "ten one"), ("10.9.9.9", "ten"), ("2001:db8:0:1::9", "v6 net"), ("2001:db8::1", "v6"), ("2001:db9::1", None), ("8.8.8.8", "all"), ("x", None)]
    assert got == sorted(want)
    bits = lambda ip: spark.range(1).select(net.address_bits(F.lit(ip)).alias("b")).first().b
    assert bits("::1") == "0" * 127 + "1" and bits("1:2:3:4:5:6:7:8")[:32] == "00000000000000010000000000000010" and bits("1:2:3") is None and bits("1::2::3") is None and bits("256.1.1.1") is None


def test_registry(spark):
    rows = spark.createDataFrame([(1, "", "", "AA:BB:CC:1"), (2, "x.apple.com", "", "00:00:00:1"), (3, "", "", None)], "i int, sni string, dns_domain string, src_mac string")
    registry = spark.createDataFrame([("aa:bb:cc", "Acme"), ("AA:BB:CC", "Zulu")], "prefix string, vendor string")
    assert sorted((r.i, r.device_manufacturer) for r in classify.with_manufacturer(rows, registry).collect()) == [(1, "Acme"), (2, "Apple"), (3, "")]
