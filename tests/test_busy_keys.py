"""Orders of busy keys in chunks against plain loops: sessions, gaps, running sums, the last sighting of an address."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowlens.operators import devices, sessions
from flowlens.operators.chunks import chunked, with_previous, with_running


def frame(spark, rows, schema="k string, at long, id long"):
    return spark.createDataFrame(rows, schema).repartition(4)


def plain_sessions(rows, idle, lifetime):
    by = defaultdict(list)
    for k, at, _ in rows:
        by[k].append(at)
    out = []
    for k, times in by.items():
        times.sort()
        parts = defaultdict(list)
        for t, n in zip(times, sessions.split_sessions(times, idle, lifetime), strict=True):
            parts[n].append(t)
        out += [(k, p[0], p[-1], len(p)) for p in parts.values()]
    return sorted(out, key=str)


@pytest.mark.parametrize(("idle", "lifetime", "chunk", "step"), [(5, 20, 25, 6), (5, 20, 40, 3), (30, 7, 37, 6), (3, 100, 103, 3), (5, 20, 10_000, 6), (1, 1, 2, 2)])
def test_sessions(spark, idle, lifetime, chunk, step):
    rng = random.Random(idle * lifetime + chunk)
    rows, n = [], 0
    for k, size in (("busy", 900), ("b", 40), (None, 60), ("one", 1)):
        at = rng.randint(-500, 500)
        for _ in range(size):
            rows.append((k, at, n))
            at += rng.choice([0, 1, 1, 2, step])
            n += 1
    got = sessions.capped_sessions(frame(spark, rows), ["k"], "at", idle, lifetime, chunk).collect()
    assert sorted(map(tuple, got), key=str) == plain_sessions(rows, idle, lifetime)
    assert sessions.capped_sessions(frame(spark, []), ["k"], "at", idle, lifetime, chunk).count() == 0
    with pytest.raises(ValueError, match="chunk"):
        sessions.session_starts(frame(spark, rows), ["k"], "at", idle, lifetime, idle + lifetime - 1)


def test_a_run_over_many_chunks(spark):
    """One key, a row each second for hours: hundreds of chunks without a gap, of a minute each."""
    rows = [("hot", 3 * 10**9 + t, t) for t in range(20_000)]
    got = sessions.capped_sessions(frame(spark, rows), ["k"], "at", 15, 41, 60).collect()
    assert sorted(map(tuple, got), key=str) == plain_sessions(rows, 15, 41)


def test_previous_and_running(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-300, 300), i) for i in range(400)]
    df = chunked(frame(spark, rows), "at", 50)
    df = with_running(with_previous(df, ["k"], "at", "id"), ["k"], "at", "id", F.col("id"), "total")
    df = with_running(df, ["k"], "at", "id", F.lit(1), "before", to=-1)
    got = {r.id: (r._previous, r.total, r.before) for r in df.collect()}
    by = defaultdict(list)
    for k, at, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        earlier = by[k]
        assert got[i] == (earlier[-1][0] if earlier else None, sum(x for _, x in earlier) + i, len(earlier))
        by[k].append((at, i))


def test_idle_sessions_and_gaps(spark):
    rows = frame(spark, [("a", t * 10**9, i) for i, t in enumerate([0, 5, 30, 31, 31, 90])])
    assert sessions.interarrival(rows, ["k"], "at", "id", 10 * 10**9, chunk=2 * 10**9).collect()[0][1:] == (2_000_000.0, 3)
    stamped = rows.select("k", F.timestamp_micros(F.expr("at div 1000")).cast("timestamp_ntz").alias("ts"), "id")
    got = sessions.idle_sessions(stamped, ["k"], "ts", "id", 10, chunk=7_000_000).orderBy("session").collect()
    assert [(r.session, r.rows) for r in got] == [(1, 2), (2, 3), (3, 1)]


def test_macs(spark):
    rng = random.Random(9)
    seen = [(rng.choice(["x", "y", None]), rng.randint(0, 20_000), rng.choice(["m1", "m2", "", None])) for _ in range(200)]
    rows = [(i, rng.choice(["x", "y", "z", None]), rng.randint(0, 25_000)) for i in range(300)]
    got = devices.mac_as_of(spark.createDataFrame(rows, "n long, ip string, at long"), spark.createDataFrame(seen, "ip string, at long, mac string"), 3600, 300)
    assert got.columns == ["n", "ip", "at", "mac"]
    for r in got.collect():
        near = [(t, m) for ip, t, m in seen if ip is not None and ip == r.ip and m and t <= r.at and r.at - t <= 3600]
        assert r.mac == (max(near)[1] if near else None), r
    assert got.count() == len(rows)
