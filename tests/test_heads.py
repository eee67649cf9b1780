"""Hellos in several segments: heads against plain reassembly, flows that tell them, and the stream."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens import schema
from flowlens.operators import layers, reassembly, sessions
from flowlens.sources import payloads
from flowlens.streaming import jobs
from test_functions import client_hello, record

SF = "/root/testdata/sf0.001"
IP = [bytes([10, 0, 0, i]) for i in range(4)]


def packet(seq, at, tcp_seq, data, src=1, port=1000):
    return (seq, int(at * 10**9), bytearray(IP[src]), bytearray(IP[0]), port, 443, 6, bytearray(data), bytearray(6), 0, 0, tcp_seq)


def frame(spark, rows):
    return spark.createDataFrame(rows, schema.PACKETS)


def found(df):
    return sorted((r.seq, bytes(r.head)) for r in df.collect())


def cut(data, rng, base, overlap=0):
    """(tcp_seq, bytes) of a random cut, in random order."""
    ends = sorted({*rng.sample(range(1, len(data)), rng.randint(0, 4)), len(data)})
    pieces = [(base + a, data[a : min(len(data), b + overlap)]) for a, b in zip([0, *ends], ends)]
    rng.shuffle(pieces)
    return pieces


@pytest.mark.parametrize("seed", [1, 2])
def test_random_cuts(spark, seed):
    rng = random.Random(seed)
    rows, want, n = [], [], 0
    for i in range(60):
        data = record(client_hello("h%d.example" % i)) + rng.choice([b"", b"next record"])
        size = len(record(client_hello("h%d.example" % i)))
        pieces = cut(data, rng, 5000 + rng.randint(0, 20_000), rng.choice([0, 3, 500]))
        missing = rng.random() < 0.2 and len(pieces) > 1
        sent = pieces[1:] if missing else pieces + rng.sample(pieces, rng.randint(0, len(pieces)))
        for k, (place, part) in enumerate(sent):
            rows.append(packet(n, i * 200 + k, place, part, port=2000 + i))
            n += 1
        base = min(p for p, _ in pieces)
        if any(len(d) < size for p, d in pieces if p == base):
            got = reassembly.record_head(dict(sent), base)
            if got:
                want.append(got[0])
    got = found(reassembly.heads(frame(spark, rows).repartition(4)))
    assert sorted(h for _, h in got) == sorted(want) and len(got) > 12
    assert len({s for s, _ in got}) == len(got)


def test_cases(spark):
    hello = record(client_hello("a.example"))
    a, b, c = hello[:40], hello[40:90], hello[90:]
    cases = [
        # packets, what is found: (seq of the packet that completes the record, record)
        ([(1, 0, 100, c[:0] + a), (2, 1, 190, c), (3, 2, 140, b)], [(3, hello)]),
        ([(1, 0, 190, c), (2, 1, 140, b), (3, 2, 100, a)], [(3, hello)]),
        ([(1, 0, 100, a), (2, 1, 140, b), (3, 2, 100, a), (4, 3, 190, c), (5, 4, 190, c)], [(4, hello)]),
        ([(1, 0, 100, a), (2, 1, 120, hello[20:90]), (3, 2, 150, hello[50:]), (4, 9, 190, c)], [(3, hello)]),
        ([(1, 0, 100, a), (2, 1, 190, c)], []),
        ([(1, 0, 100, a), (2, 1, 140, b), (3, 100, 190, c)], []),
        ([(1, 0, 100, hello)], []),
        ([(1, 0, 100, hello[:1]), (2, 1, 101, hello[1:3]), (3, 2, 103, hello[3:] + b"more")], [(3, hello)]),
        ([(1, 0, 100, b"x" * 50), (2, 1, 150, hello[:9]), (3, 2, 159, hello[9:])], [(3, hello)]),
        ([(1, 0, 0, a), (2, 1, 0, b + c)], []),
        ([(k + 1, k / 100, 16_300 + k, hello[k : k + 1]) for k in range(len(hello))], [(len(hello), hello)]),
    ]
    rows, want = [], []
    for i, (packets, heads) in enumerate(cases):
        rows += [packet(1000 * i + s, t, q, d, port=3000 + i) for s, t, q, d in packets]
        want += [(1000 * i + s, h) for s, h in heads]
    got = found(reassembly.heads(frame(spark, rows).repartition(3)))
    assert [(s, h) for s, h in got] == sorted(want)
    assert found(reassembly.heads(frame(spark, []))) == []


def test_two_directions_and_hellos_of_one_flow(spark):
    one, two = record(client_hello("one.example")), record(client_hello("two.example"))
    rows = [packet(1, 0, 100, one[:30]), packet(2, 1, 130, one[30:]), packet(3, 2, 9000, two[:30]), packet(4, 3, 9030, two[30:]), packet(5, 3, 130, one[30:], src=2)]
    packets = frame(spark, rows)
    fields = layers.fields(packets)
    flow = sessions.flows_from_packets(fields, ("sni", "ja3"), layers.hellos(packets)).where("src_ip = '10.0.0.1'").first()
    assert (flow.sni, len(flow.ja3), flow.packets_up) == ("two.example", 64, 4)
    without = sessions.flows_from_packets(fields, ("sni", "ja3")).where("src_ip = '10.0.0.1'").first()
    assert (without.sni, without.ja3) == ("", "")


def test_stream_equals_batch(spark, tmp_path):
    packets = payloads.split_hellos(spark.read.parquet(f"{SF}/events.parquet").limit(150))
    want = [h for _, h in found(reassembly.heads(packets))]
    path, out = str(tmp_path / "in"), []
    ordered = packets.orderBy("timestamp_ns").collect()
    for at in range(0, len(ordered), 60):  # several micro-batches
        spark.createDataFrame(ordered[at : at + 60], packets.schema).coalesce(1).write.mode("append").parquet(path)
    for _ in range(2):  # the second run goes on from the checkpoint and finds nothing new
        stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = jobs.heads(stream, "40 days").writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(bytes(r.head) for r in out) == sorted(want) and len(want) > 60


def test_joined_behind_a_gap():
    segments = [(1, b"a"), *[(3 + 2 * i, b"cd") for i in range(20_000)], (2, b"b")]
    assert reassembly.joined(segments) == b"ab" + b"cd" * 20_000
    assert reassembly.joined([(1, b"a"), (9, b"z"), (4, b"d"), (3, b"c"), (2, b"b")], held=2) == b"abc"
