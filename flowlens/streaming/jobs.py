"""Streaming counterparts: flows from packets, minute totals, first-seen names and cooled alerts.

Times are event times; late rows are dropped by watermark. State is kept for each key by Spark, with timeouts, so
neither the number of flows nor that of devices needs a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens import schema
from flowlens.functions import net
from flowlens.operators import anomaly, reassembly, sessions
from flowlens.operators.traffic import volume
from flowlens.sources import tables

_FLOW = "key string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, src_mac string, first_seen long, last_seen long, packets_up long, packets_down long, bytes_up long, bytes_down long, pkt_size_hist array<long>, pkt_iat_mean_us double, duration_ms long"
_STATE = "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, src_mac string, first_seen long, last_seen long, packets_up long, packets_down long, bytes_up long, bytes_down long, hist array<long>, gap_ns long, gaps long"


def minute_totals(flows: DataFrame, watermark: str = "60 seconds") -> DataFrame:
    rows = flows.withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("flows"), F.sum(volume()).alias("bytes")).select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "flows", "bytes")


def latest_versions(flows: DataFrame, watermark: str = "60 seconds") -> DataFrame:
    """Repeated deliveries of a flow row within the watermark are dropped."""
    return flows.withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["timestamp", "src_ip", "first_seen"]).drop("ts")


def _open(p) -> list:
    return [p.src, p.dst, int(p.src_port), int(p.dst_port), "TCP" if p.protocol == 6 else "UDP", p.mac, int(p.timestamp_ns), int(p.timestamp_ns), 0, 0, 0, 0, [0] * 7, 0, 0]


def _add(s: list, p) -> None:
    gap = int(p.timestamp_ns) - s[7]
    if s[8] + s[9] and gap < sessions.GAP_NS:
        s[13], s[14] = s[13] + gap, s[14] + 1
    s[7] = max(s[7], int(p.timestamp_ns))
    up = (p.src, int(p.src_port)) == (s[0], s[2])
    s[8 if up else 9] += 1
    s[10 if up else 11] += int(p.size)
    s[12][next((i for i, b in enumerate(net.SIZE_BOUNDS) if p.size <= b), len(net.SIZE_BOUNDS))] += 1


def _close(key: str, s: list) -> list:
    return [key, *s[:13], s[13] / s[14] / 1000 if s[14] else 0.0, (s[7] - s[6]) // 1_000_000]


def _flows_of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    done: list[list] = []
    open_ = [list(x) if isinstance(x, (list, tuple)) or hasattr(x, "__array__") else x for x in state.get] if state.exists else None
    if state.hasTimedOut:
        done.append(_close(key[0], open_))
        state.remove()
    else:
        rows = pd.concat(batches).sort_values(["timestamp_ns", "seq"])
        for p in rows.itertuples():
            if open_ and (p.timestamp_ns - open_[7] > sessions.IDLE_S * 10**9 or p.timestamp_ns - open_[6] > sessions.LIFETIME_S * 10**9):
                done.append(_close(key[0], open_))
                open_ = None
            open_ = open_ or _open(p)
            _add(open_, p)
            if p.ends:
                done.append(_close(key[0], open_))
                open_ = None
        if open_:
            state.update(tuple(open_))
            state.setTimeoutTimestamp(max(open_[7] // 10**6 + sessions.IDLE_S * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
    yield pd.DataFrame(done, columns=[x.strip().split(" ")[0] for x in _FLOW.split(", ")])


def flows(packets: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Flow rows of a stream of packets (PACKETS), by the rules of sessions.flows_from_packets."""
    rows = packets.withColumn("ts", F.expr("timestamp_micros(timestamp_ns div 1000)")).withWatermark("ts", watermark)
    rows = rows.withColumn("src", net.ip_text(F.col("src_ip"))).withColumn("dst", net.ip_text(F.col("dst_ip")))
    rows = rows.select(
        "ts", "seq", "timestamp_ns", "src", "dst", "src_port", "dst_port", "protocol", net.mac_text(F.col("src_mac")).alias("mac"), (F.length("payload") + sessions.HEADER_BYTES).cast("long").alias("size"),
        F.coalesce(F.col("tcp_flags").bitwiseAND(sessions.FIN | sessions.RST) > 0, F.lit(False)).alias("ends"), F.to_json(net.flow_key(F.col("src"), F.col("src_port"), F.col("dst"), F.col("dst_port"), F.col("protocol"))).alias("key"),
    )
    return rows.groupBy("key").applyInPandasWithState(_flows_of, _FLOW, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


_HELD_STATE = "whole boolean, places array<long>, pieces array<binary>, times array<long>, seqs array<long>"


def _record_of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    whole, held = False, {}
    if state.exists:
        whole, *lists = state.get
        held = {int(p): (bytes(d), int(t), int(s)) for p, d, t, s in zip(*lists, strict=True)}
    if state.hasTimedOut:
        state.remove()
        return
    found, latest = [], 0
    for p in pd.concat(batches).sort_values(["timestamp_ns", "seq"]).itertuples():
        latest = max(latest, p.timestamp_ns)
        if whole:
            continue
        data, place = bytes(p.payload), int(p.tcp_seq)
        if place not in held or len(held[place][0]) < len(data):
            held[place] = data, int(p.timestamp_ns), int(p.seq)
        held = {x: v for x, v in held.items() if p.timestamp_ns - v[1] <= reassembly.RECORD_S * 10**9}
        pieces = {x: v[0] for x, v in held.items()}
        for base in (x for x, d in pieces.items() if reassembly.begins_record(d)):
            got = reassembly.record_head(pieces, base)
            if got and len(pieces[base]) < len(got[0]):
                found.append((int(p.seq), got[0]))
                whole, held = True, {}
                break
    # nothing is held once a record is whole; the mark goes when the direction is quiet
    state.update((whole, list(held), [v[0] for v in held.values()], [v[1] for v in held.values()], [v[2] for v in held.values()]))
    state.setTimeoutTimestamp(max(latest // 10**6 + 1000 * reassembly.RECORD_S, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(found, columns=["seq", "head"])


def heads(packets: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """seq, head of a stream of packets (PACKETS), as `reassembly.heads`: of each direction the first record that takes
    several segments. What a direction holds is what came in the last RECORD_S, and nothing once its record is whole."""
    rows = packets.where("protocol = 6 and tcp_seq <> 0 and length(payload) > 0").withColumn("ts", F.expr("timestamp_micros(timestamp_ns div 1000)")).withWatermark("ts", watermark)
    rows = rows.select("ts", "src_ip", "src_port", "dst_ip", "dst_port", "seq", "timestamp_ns", "tcp_seq", "payload")
    return rows.groupBy(*reassembly.DIRECTION).applyInPandasWithState(_record_of, "seq long, head binary", _HELD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _cooled(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
    rows = pd.concat(batches).sort_values(["timestamp", "event_id"])
    keep = []
    for when in rows["timestamp"]:
        keep.append(last is None or (when - last).total_seconds() >= anomaly.COOLDOWN_S)
        last = when if keep[-1] else last
    state.update((last.value // 1000,))
    state.setTimeoutTimestamp(max(last.value // 10**6 + 1000 * anomaly.COOLDOWN_S, state.getCurrentWatermarkMs() + 1))
    yield rows[keep].drop(columns=["ts"])


def cooled_alerts(alerts: DataFrame, watermark: str = "60 seconds") -> DataFrame:
    """alerts: event_id, timestamp, src_ip, src_mac, risk_score, reason. One for each address and reason in five minutes."""
    rows = alerts.select("event_id", "timestamp", "src_ip", "src_mac", "risk_score", "reason", F.col("timestamp").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return rows.groupBy("src_ip", "reason").applyInPandasWithState(_cooled, "event_id long, timestamp timestamp_ntz, src_ip string, src_mac string, risk_score int, reason string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def write_tables(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Appends a stream to a table by month; a batch that is repeated after a failure writes its own folder anew."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("yyyymm", F.date_format("timestamp", "yyyyMM").cast("int"))
        rows.write.mode("overwrite").partitionBy("yyyymm").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: The tables that records of the JSON source go to, and the rows that each takes.
BRANCHES = {"flows": tables.flow_records, "devices": tables.device_records, "sessions": tables.session_records}


def fan_out_batch(lines: DataFrame, number: int, path: str) -> None:
    """One micro-batch of lines (value) to the branches' tables and `quarantine`, which takes what isn't a record.

    Each table has a folder for each batch, which a repeated batch writes anew: whatever failed between two tables, a replay
    leaves every record once. `read_branch` reads a table.
    """
    parsed = lines.select("value", F.from_json("value", schema.UDP_JSON + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    parsed = parsed.persist()
    try:
        good = parsed.where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")
        for name, branch in BRANCHES.items():
            branch(good).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        parsed.where("trim(value) <> '' and (r is null or r._corrupt is not null)").select("value").write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")
    finally:
        parsed.unpersist()


def fan_out(lines: DataFrame, path: str, checkpoint: str, **trigger):
    """Writes a stream of JSON lines (value) to the tables of BRANCHES and the quarantine under path."""
    return lines.writeStream.foreachBatch(lambda batch, number: fan_out_batch(batch, number, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_branch(spark, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")
