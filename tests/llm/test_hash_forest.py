"""Operator 13: recall against brute force, exact scores and ties, runs across partitions, odd rows."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import hash_forest as hf

SCHEMA = "vec_id long, embedding array<double>, c string, q string, v string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", "q", None, "s") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, every=20, k=20):
    """Brute force over distinct rows that take part."""
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in rows:
        if i % every == 0:
            near = sorted((-float(np.sum(np.array(v) * np.array(w))), j) for j, w in rows if (j, w) != (i, v))
            out.setdefault(i, []).append([(j, -s) for s, j in near[:k]])
    return out


def found(df):
    by = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    return by


def recall(got, want):
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in lists[0]}) for q, lists in want.items())
    return hits / sum(len(lists[0]) for lists in want.values())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    df = hf.op13_hash_forest(spark, path)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = found(df), plain(rows)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in {j for j, _ in near}
        assert all(abs(s - float((vectors[q] * vectors[j]).sum())) < 1e-12 for j, s in near)


def test_prefixes_find_neighbours(spark, monkeypatch):
    """Clusters of near copies: the ascent ends below the root, and no level is compared as a whole."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.1 * rng.normal(size=32)]) for i in range(2400)]
    seen = []
    visits = hf._visits
    monkeypatch.setattr(hf, "_visits", lambda runs, state, places: (seen.extend(r.level for r in state.collect()), visits(runs, state, places))[1])
    monkeypatch.setattr(hf, "PART_ROWS", 5000)
    monkeypatch.setattr(hf, "SLICE", 64)
    monkeypatch.setattr(hf, "VISITS", 8)
    got, want = found(hf.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, trees=16, depth=6)), plain(rows)
    assert recall(got, want) >= 0.9 and min(seen) > 0


def test_runs_across_partitions(spark):
    rng = np.random.default_rng(8)
    entries = [(t, bytes(rng.integers(0, 2, 4).astype(np.uint8)), m, int(c)) for t in range(3) for c in range(300) for m in ([0, 1] if c % 20 == 0 else [0])]
    df = spark.createDataFrame(entries, "tree int, key binary, mark int, c long")
    for parts in (1, 7, 40):
        forest = hf.written(hf._forest(df, parts, 4), "forest")
        places = hf._Places(forest.where("kind = 'ends'").collect(), 4)
        ordered = sorted((t, k, c) for t, k, m, c in entries if m == 0)
        slices = {(r.part, r.slice): r.ids for r in forest.where("kind = 'slice'").collect()}
        assert [c for p in sorted(slices) for c in slices[p]] == [c for _, _, c in ordered]
        keys = {(t, c): k for t, k, m, c in entries if m == 1}
        for r in hf._runs(forest, places, 4).collect():
            for level in range(5):
                mine = [i for i, (t, k, _) in enumerate(ordered) if t == r.tree and k[:level] == keys[r.tree, r.c][:level]]
                low, high = r.low[level], r.high[level]
                assert (low, high) == (mine[0], mine[-1] + 1) if mine else low == high


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5) * rng.choice([0.01, 1, 30])]) for i in range(90)]
    same = [1.0, 2.0, 0.0, -1.0, 3.0]
    rows += [(i, same) for i in range(100, 400)] + [(100, same), (120, same)]
    rows += [(500, None), (520, []), (540, [0.0] * 5), (560, [math.nan, 1.0, 1.0, 1.0, 1.0]), (580, [None, 1.0, 1.0, 1.0, 1.0]), (600, [math.inf, 0.0, 0.0, 0.0, 0.0]), (None, same), (40, [9.0, 0.0, -0.0, 1.0, 1.0])]
    got = hf.nearest(table(spark, rows), F.col("vec_id") % 20 == 0)
    want = plain(rows)
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.query_id].append((r.vec_id, r.score))
    # small tables are compared at the root: exact, ties included
    for q, lists in want.items():
        assert collections.Counter((j, round(s, 9)) for j, s in by[q]) == collections.Counter((j, round(s, 9)) for x in lists for j, s in x)
    assert set(by) == set(want) and 500 not in by


def test_few_rows(spark):
    asks = F.col("vec_id") % 20 == 0
    assert hf.nearest(table(spark, []), asks).count() == 0
    assert hf.nearest(table(spark, [(20, [1.0, 0.0])]), asks).count() == 0
    got = hf.nearest(table(spark, [(20, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [0.0, 1.0]), (5, [-1e200, 1e200])]), asks).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 2, 0.0), (20, 2, 3, 0.0), (20, 3, 5, -1e200)]
    assert hf.nearest(table(spark, [(1, [1.0]), (2, [2.0])]), asks).count() == 0
    with pytest.raises(ValueError, match="one length"):
        hf.nearest(table(spark, [(20, [1.0, 2.0]), (2, [0.5])]), asks)
