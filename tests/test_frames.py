"""The source of framed packets: rows in batch and as a stream over a restart, growing files, damaged and oversized messages."""

import struct

from flowlens.operators import sessions
from flowlens.sources import frames, payloads

SF = "/root/testdata/sf0.001"
FIELDS = ["timestamp_ns", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "payload", "src_mac", "snaplen", "tcp_flags", "tcp_seq"]


def plain(rows):
    return sorted(tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in (r[f] for f in FIELDS)) for r in rows)


def test_batch(spark, tmp_path):
    spark.dataSource.register(frames.FramesSource)
    packets = payloads.packets(spark.read.parquet(f"{SF}/events.parquet"))
    rows = packets.collect()
    tuples = [tuple(r[f] for f in FIELDS) for r in rows]
    for name, part in (("agent-a", tuples[:600]), ("agent-b", tuples[600:])):
        (tmp_path / name).write_bytes(b"".join(frames.message(part[i : i + 64]) for i in range(0, len(part), 64)))
    (tmp_path / "_hidden").write_bytes(b"x")
    got = spark.read.format("packet_frames").load(str(tmp_path))
    assert plain(frames.packets(got).collect()) == plain(rows)
    seqs = [r.seq for r in got.collect()]
    assert len(set(seqs)) == len(seqs)
    count = lambda df: df.count()
    assert count(sessions.flows_from_packets(frames.packets(got))) == count(sessions.flows_from_packets(packets))


def test_damage_is_isolated(spark, tmp_path):
    spark.dataSource.register(frames.FramesSource)
    packet = lambda i: (i, bytes(4), bytes(16), 1, 2, 6, b"data", bytes(6), 9, 1, 7)
    good = [frames.message([packet(i), packet(i + 100)]) for i in range(3)]
    broken = bytearray(frames.message([packet(50)]))
    broken[4:12] = struct.pack("<Q", 3)  # says three packets and has one
    (tmp_path / "a").write_bytes(good[0] + bytes(broken) + good[1] + frames.message([]) + good[2][:-1])
    (tmp_path / "b").write_bytes(good[2] + struct.pack("<I", frames.MAX_MESSAGE + 1) + good[0])
    (tmp_path / "c").write_bytes(b"")
    rows = spark.read.format("packet_frames").load(str(tmp_path)).collect()
    assert sorted((r.source, r.timestamp_ns) for r in rows if r.error is None) == [("a", 0), ("a", 1), ("a", 100), ("a", 101), ("b", 2), ("b", 102)]
    errors = sorted((r.source, r.error.split(": ")[1]) for r in rows if r.error)
    assert errors == [("a", "a message ends within a packet"), ("a", "the file ends within it"), ("b", "longer than a message may be")]


def test_stream_over_a_restart(spark, tmp_path):
    spark.dataSource.register(frames.FramesSource)
    folder, out = tmp_path / "in", []
    folder.mkdir()
    packet = lambda i: (i, bytes(4), bytes(4), 1, 2, 6, b"x" * i, bytes(6), 9, 1, 7)
    messages = [frames.message([packet(i), packet(i + 50)]) for i in range(6)]

    def run():
        stream = spark.readStream.format("packet_frames").load(str(folder))
        query = stream.writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.timestamp_ns for r in out if r.error is None)

    (folder / "z").write_bytes(messages[0] + messages[1] + messages[2][:10])
    assert run() == [0, 1, 50, 51]
    (folder / "z").write_bytes(messages[0] + messages[1] + messages[2] + messages[3])
    (folder / "a").write_bytes(messages[4] + struct.pack("<I", frames.MAX_MESSAGE + 1))
    assert run() == [0, 1, 2, 3, 4, 50, 51, 52, 53, 54]
    assert run() == [0, 1, 2, 3, 4, 50, 51, 52, 53, 54]
    (folder / "b").write_bytes(messages[5])
    assert run() == [0, 1, 2, 3, 4, 5, 50, 51, 52, 53, 54, 55]
    assert [r.error.split(": ")[1] for r in out if r.error] == ["longer than a message may be"]
    assert len({r.seq for r in out}) == len(out) == 13
