"""Made addresses repeat after 62,500 users and 2^24 events: the flows over more of them are those of the SQL too."""

import duckdb
import pytest

from flowlens.operators import sessions
from flowlens.plans import messages

EVENTS = "/root/testdata/sf0.001/events.parquet"
#: Of the copy with other users, other events.
SHIFTS = {"packet_flows": "user_id + 62500 AS user_id, event_id + 1000001 AS event_id", "packet_flows_split_hellos": "event_id + (1 << 24) AS event_id"}


@pytest.mark.parametrize("name", sorted(SHIFTS))
def test_flows_of_shared_addresses(spark, tmp_path, name):
    db = duckdb.connect()
    db.execute(f"CREATE TABLE events AS SELECT * FROM '{EVENTS}' UNION ALL SELECT * REPLACE ({SHIFTS[name]}, ts + INTERVAL '9 seconds' AS ts) FROM '{EVENTS}'")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = messages.QUERIES[name](spark, str(tmp_path))
    want = db.sql(messages.ORACLE[name])
    at = [want.columns.index(c) for c in got.columns]
    rows = want.fetchall()
    assert len(rows) > 400 and sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in rows)


def test_flows_within_networks(spark):
    second = 1_000_000_000
    made = [("a", 1, 0), ("b", 2, 5), ("a", 3, 12), ("a", 4, 100), ("b", 5, 101)]
    packets = spark.createDataFrame(made, "net string, seq long, s long").selectExpr(
        "net", "seq", f"s * {second} as timestamp_ns", "X'0A000001' as src_ip", "X'0A000002' as dst_ip", "1000 as src_port", "443 as dst_port", "6S as protocol", "X'00' as payload", "X'AA80A0000001' as src_mac", "0S as tcp_flags", "0L as tcp_seq"
    )
    alike = sessions.flows_from_packets(packets).select("first_seen", "packets_up").collect()
    assert sorted((r.first_seen // second, r.packets_up) for r in alike) == [(0, 3), (100, 2)]
    flows = sessions.flows_from_packets(packets, within=("net",), numbered=True)
    assert sorted((r.net, r.number, r.first_seen // second, r.packets_up) for r in flows.collect()) == [("a", 1, 0, 2), ("a", 2, 100, 1), ("b", 1, 5, 1), ("b", 2, 101, 1)]
    added = sessions.added_flows(flows, ["src_ip", "number"]).collect()
    assert sorted((r.number, r.packets_up, r.duration_ms, r.pkt_gaps, r.pkt_iat_mean_us) for r in added) == [(1, 3, 12_000, 0, 0.0), (2, 2, 1_000, 0, 0.0)]
