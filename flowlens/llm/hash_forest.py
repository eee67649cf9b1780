"""Operator 13, approximate nearest neighbours by a forest of hash prefixes.

A vector gets a string of DEPTH symbols in each of TREES trees: each symbol names the random direction (of DIRECTIONS,
either way) that lies nearest to the vector. Long inner products become near directions by one more entry, which brings
every vector to the greatest length that there is and is 0 for queries. A tree is the array of its strings in order,
held in slices of SLICE rows; the vectors that share a prefix with a query are a run of it.

A query descends to the deepest level at which its runs of all trees hold START rows, compares them all, and ascends by
a symbol in all trees at once until a vector better than its last neighbour would have been met with probability REACH,
as simulated for the family of hashes. There is no cap on candidates. Where no prefix is sure enough, the ascent ends at
the root of a tree, where every vector is compared, in blocks.

Equal vectors are one entry of the index with the least of their ids, of which a query can need no more than it has
neighbours; so copies cost nothing. Visits of a slice are counted first and dealt to as many groups as they need.
The driver gets the ends of each partition's array (a few numbers for each), whatever the rows.

Defined results: vectors that are null, empty, zero, or hold a null or an entry that isn't finite take no part, nor do
rows without an id. Repeated rows are one row. An id on several vectors is a row for each; only the query's own row is
no candidate. With fewer candidates than neighbours asked for, all come. Vectors of several lengths are an error. Other
columns are not used, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm._shared import forget, read_table, small_batches, written

NEIGHBOURS, EVERY = 20, 20
TREES, DEPTH, DIRECTIONS = 48, 12, 64
START, REACH = 400, 0.9
SLICE, VISITS = 2048, 1024
#: Entries of all trees in one partition of the sorted arrays.
PART_ROWS = 250_000
SEED = 20240613


def usable(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: the rows that take part, each once."""
    v = F.col(f"`{vector}`")
    kind = dict(table.dtypes)[vector]
    v = v if kind in ("array<float>", "array<double>") else v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(f"`{id_column}`").isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), v.alias("v")).distinct()


def classes_of(rows: DataFrame, neighbours: int) -> DataFrame:
    """c, rep, v, members: each vector once, with its least ids (one more than neighbours) in order."""
    # the limit acts before the shuffle too, so a vector that many rows share is few rows of each task
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = rows.withColumn("_nth", nth).where(F.col("_nth") <= neighbours + 1)
    grouped = least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    return grouped.select(F.monotonically_increasing_id().alias("c"), F.col("members")[0].alias("rep"), "v", "members")


def _directions(tree: int, entries: int, depth: int) -> np.ndarray:
    """entries x (depth * DIRECTIONS): each level's directions, at right angles where there is room."""
    rng = np.random.Generator(np.random.PCG64([SEED, tree]))
    out = rng.normal(size=(depth, entries, DIRECTIONS))
    out = np.linalg.qr(out)[0] if entries >= DIRECTIONS else out / np.linalg.norm(out, axis=1, keepdims=True)
    return np.concatenate(list(out), axis=1)


def _symbols(y: np.ndarray, depth: int) -> np.ndarray:
    """Rows by depth: the nearest direction's number and sense."""
    y = y.reshape(len(y), depth, DIRECTIONS)
    at = np.abs(y).argmax(axis=2)
    return (2 * at + (np.take_along_axis(y, at[:, :, None], 2)[:, :, 0] > 0)).astype(np.uint8)


def meeting(entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines, and the simulated chance that two vectors of that cosine have one symbol in common."""
    rng = np.random.Generator(np.random.PCG64([SEED, 1 << 20]))
    cosines = np.concatenate([[-1.0], np.linspace(0, 0.95, 20), [0.98, 0.99, 1.0]])
    same = np.zeros(len(cosines))
    for tree in range(8):
        r = _directions(TREES + tree, entries, 1)
        a = rng.normal(size=(1500, entries))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        w = rng.normal(size=a.shape)
        w -= (w * a).sum(axis=1, keepdims=True) * a
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
        own = _symbols(a @ r, 1)
        same += [(own == _symbols((c * a + np.sqrt(1 - c * c) * w) @ r, 1)).mean() / 8 for c in cosines]
    return cosines, np.maximum.accumulate(same)


def _entries(classes: DataFrame, d: int, unit: float, longest: float, trees: int, depth: int) -> DataFrame:
    """tree, key, mark (0: a row, 1: a query), c. classes: c, v, asks (whether it is a query)."""
    most = max(1, min(8192, (32 << 20) // (8 * (d + 1))))

    def strings(batches):
        def emit(held):
            c, asks = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
            x = np.concatenate([h[1] for h in held]) / unit
            squares = (x * x).sum(axis=1)
            rows = np.concatenate([x, np.sqrt(np.maximum(longest * longest - squares, 0))[:, None]], axis=1)
            queries = np.concatenate([x[asks], np.zeros((int(asks.sum()), 1))], axis=1)
            both = np.concatenate([rows, queries])
            ids, mark = np.concatenate([c, c[asks]]), np.concatenate([np.zeros(len(c), np.int32), np.ones(len(queries), np.int32)])
            for tree in range(trees):
                key = np.ascontiguousarray(_symbols(both @ _directions(tree, d + 1, depth), depth))
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(depth), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), tree, np.int32)), binary, pa.array(mark), pa.array(ids)], ["tree", "key", "mark", "c"])

        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append((batch.column("c").to_numpy(), _vectors(batch.column("v"), d), batch.column("asks").to_numpy(zero_copy_only=False)))
                size += len(batch)
            if size >= most:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return classes.select("c", "v", "asks").mapInArrow(strings, "tree int, key binary, mark int, c long")


def _vectors(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


_FOREST = "kind string, part long, tree int, c long, first array<long>, last array<long>, left int, right int, slice long, ids array<long>, head binary, tail binary, head_tree int, tail_tree int, rows long"


def _common(a: np.ndarray, b: np.ndarray, same_tree: np.ndarray) -> np.ndarray:
    """Symbols that keys have in common, -1 in different trees."""
    differ = a != b
    return np.where(same_tree, np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), -1)


def _forest(entries: DataFrame, parts: int, depth: int) -> DataFrame:
    """The sorted arrays. kind `slice`: class ids of SLICE rows; `query`: for each level (0: the whole tree) the run of a
    query's prefix within its partition, and the levels at which it reaches the partition's ends; `ends`: of a partition."""
    names = [x.split(" ")[0] for x in _FOREST.split(", ")]
    types = {"kind": pa.string(), "tree": pa.int32(), "first": pa.list_(pa.int64()), "last": pa.list_(pa.int64()), "left": pa.int32(), "right": pa.int32(), "ids": pa.list_(pa.int64()), "head": pa.binary(), "tail": pa.binary(), "head_tree": pa.int32(), "tail_tree": pa.int32()}

    def batch(n: int, **columns) -> pa.RecordBatch:
        arrays = []
        for name in names:
            kind = types.get(name, pa.int64())
            value = columns.get(name)
            arrays.append(pa.nulls(n, kind) if value is None else value if isinstance(value, pa.Array) else pa.array(value, kind))
        return pa.RecordBatch.from_arrays(arrays, names)

    def build(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = [b for b in batches if len(b)]
        if not held:
            return
        tree, mark, c = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in ("tree", "mark", "c"))
        key = np.concatenate([np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint8).reshape(len(b), depth) for b in held])
        m = len(tree)
        rows = np.concatenate([[0], np.cumsum(mark == 0)])
        shared = _common(key[1:], key[:-1], tree[1:] == tree[:-1])
        asks = np.flatnonzero(mark == 1)
        first, last = np.zeros((len(asks), depth + 1), np.int64), np.zeros((len(asks), depth + 1), np.int64)
        head_hi, tail_lo = [], []
        for level in range(depth + 1):
            starts = np.concatenate([[0], np.flatnonzero(shared < level) + 1])
            ends = np.append(starts[1:], m)
            run = np.searchsorted(starts, asks, "right") - 1
            first[:, level], last[:, level] = rows[starts[run]], rows[ends[run]]
            head_hi.append(int(rows[ends[0]]))
            tail_lo.append(int(rows[starts[-1]]))
        yield batch(1, kind=["ends"], part=[part], rows=[int(rows[-1])], first=[tail_lo], last=[head_hi], head=[key[0].tobytes()], tail=[key[-1].tobytes()], head_tree=[int(tree[0])], tail_tree=[int(tree[-1])])
        ids = c[mark == 0]
        for k, at in enumerate(range(0, len(ids), SLICE)):
            yield batch(1, kind=["slice"], part=[part], slice=[k], tree=[-1], ids=[ids[at : at + SLICE]])
        left = _common(key[asks], np.broadcast_to(key[0], (len(asks), depth)), tree[asks] == tree[0])
        right = _common(key[asks], np.broadcast_to(key[-1], (len(asks), depth)), tree[asks] == tree[-1])
        for at in range(0, len(asks), 4096):
            s = slice(at, min(at + 4096, len(asks)))
            n = s.stop - s.start
            flat = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (depth + 1)), pa.array(a[s].ravel()))  # noqa: B023, E731
            yield batch(n, kind=["query"] * n, part=[part] * n, tree=tree[asks[s]].tolist(), c=c[asks[s]].tolist(), first=flat(first), last=flat(last), left=left[s].tolist(), right=right[s].tolist())

    order = ["tree", "key", "mark", "c"]
    # c is in the order, so that partitions can part equal strings
    return entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(build, _FOREST)


class _Places:
    """Where partitions' rows begin in the order of all, and the whole runs at their ends."""

    def __init__(self, ends: list, depth: int):
        ends = sorted(ends, key=lambda r: r.part)
        self.parts = np.array([r.part for r in ends], np.int64)
        self.begin = np.concatenate([[0], np.cumsum([r.rows for r in ends])]).astype(np.int64)
        n = len(ends)
        self.low, self.high = np.zeros((n, depth + 1), np.int64), np.zeros((n, depth + 1), np.int64)
        for level in range(depth + 1):
            joins = lambda i: ends[i].tail_tree == ends[i + 1].head_tree and bytes(ends[i].tail[:level]) == bytes(ends[i + 1].head[:level])  # noqa: B023, E731
            whole = lambda i: ends[i].head_tree == ends[i].tail_tree and bytes(ends[i].head[:level]) == bytes(ends[i].tail[:level])  # noqa: B023, E731
            # low: where the run of a partition's first entry begins; high: where that of its last entry ends
            for i in range(n):
                self.low[i, level] = self.begin[i]
                if i and joins(i - 1):
                    self.low[i, level] = self.low[i - 1, level] if whole(i - 1) else self.begin[i - 1] + ends[i - 1].first[level]
            for i in reversed(range(n)):
                self.high[i, level] = self.begin[i + 1]
                if i + 1 < n and joins(i):
                    self.high[i, level] = self.high[i + 1, level] if whole(i + 1) else self.begin[i + 1] + ends[i + 1].last[level]


def _runs(forest: DataFrame, places: _Places, depth: int) -> DataFrame:
    """c, tree, low, high: for each level the places of a query's run in the order of all."""

    def resolve(batches):
        for batch in batches:
            if not len(batch):
                continue
            at = np.searchsorted(places.parts, batch.column("part").to_numpy())
            levels = np.arange(depth + 1)
            first, last = (_vectors(batch.column(k), depth + 1).astype(np.int64) + places.begin[at][:, None] for k in ("first", "last"))
            low = np.where(batch.column("left").to_numpy()[:, None] >= levels, places.low[at], first)
            high = np.where(batch.column("right").to_numpy()[:, None] >= levels, places.high[at], last)
            rows = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * (depth + 1))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("tree"), *[pa.ListArray.from_arrays(rows, pa.array(x.ravel())) for x in (low, high)]], ["c", "tree", "low", "high"])

    return forest.where("kind = 'query'").select("part", "tree", "c", "first", "last", "left", "right").mapInArrow(resolve, "c long, tree int, low array<long>, high array<long>")


def _visits(runs: DataFrame, state: DataFrame, places: _Places) -> DataFrame:
    """part, slice, q, low, high (places within the slice), bar: what each query of `state` (q, level, bar) compares."""

    def cut(batches):
        for batch in batches:
            for q, low, high, bar in zip(*[batch.column(k).to_pylist() for k in ("q", "low", "high", "bar")], strict=True):
                out = [[], [], [], []]
                i = int(np.searchsorted(places.begin, low, "right")) - 1
                while low < high:
                    begin, end = int(places.begin[i]), int(places.begin[i + 1])
                    to = min(high, end)
                    while low < to:
                        s = (low - begin) // SLICE
                        stop = min(to, begin + (s + 1) * SLICE)
                        for column, value in zip(out, (int(places.parts[i]), s, low - begin - s * SLICE, stop - begin - s * SLICE), strict=True):
                            column.append(value)
                        low = stop
                    i += 1
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out[0], out[1], [q] * len(out[0]), out[2], out[3])] + [pa.array([bar] * len(out[0]), pa.float64())], ["part", "slice", "q", "low", "high", "bar"])

    rows = runs.join(state, runs["c"] == state["q"]).where((F.col("level") > 0) | (F.col("tree") == 0))
    rows = rows.select("q", F.get("low", F.col("level")).alias("low"), F.get("high", F.col("level")).alias("high"), "bar").where("low < high")
    return rows.mapInArrow(cut, "part long, slice long, q long, low long, high long, bar double")


def _compared(forest: DataFrame, classes: DataFrame, visits: DataFrame, d: int, most: int) -> DataFrame:
    """q, c, rep, score: the best `most` of each visit, all that tie with the last by score and least id put in order."""
    place = ["part", "slice"]
    loads = visits.groupBy(*place).agg(F.ceil(F.count("*") / VISITS).cast("int").alias("groups"))
    rows = forest.where("kind = 'slice'").join(loads, place).select(*place, "groups", F.posexplode("ids").alias("at", "c")).join(classes.select("c", "rep", "v"), "c")
    rows = rows.select(*place, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "at", "c", "rep", "v")
    asked = visits.join(loads, place).join(classes.select(F.col("c").alias("q"), F.col("v").alias("asked")), "q")
    asked = asked.select(*place, F.pmod(F.xxhash64("q", "low"), F.col("groups")).cast("int").alias("group"), "q", "low", "high", "bar", "asked")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        x, at, c, rep = _vectors(left["v"], d), left["at"].to_numpy(), left["c"].to_numpy(), left["rep"].to_numpy()
        tables = [empty]
        for start in range(0, len(right), VISITS):
            part = right.slice(start, VISITS)
            y, q = _vectors(part["asked"], d), part["q"].to_numpy()
            near = y @ x.T
            inside = (at >= part["low"].to_numpy()[:, None]) & (at < part["high"].to_numpy()[:, None])
            # products of blocks are exact to rounding only: what is near the bar is judged below
            slack = 1e-10 * np.linalg.norm(y, axis=1) * np.linalg.norm(x, axis=1).max()
            bar = part["bar"].to_numpy() - slack
            near = np.where(inside & (near >= bar[:, None]), near, -np.inf)
            if near.shape[1] > most:
                near = np.where(near >= np.partition(near, -most, axis=1)[:, -most, None] - slack[:, None], near, -np.inf)
            i, j = np.nonzero(near > -np.inf)
            # summed alike wherever a pair meets
            score = (y[i] * x[j]).sum(axis=1)
            order = np.lexsort((rep[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            keep = nth < most
            tables.append(pa.table({"q": pa.array(q[i[keep]]), "c": pa.array(c[j[keep]]), "rep": pa.array(rep[j[keep]]), "score": pa.array(score[keep])}))
        return pa.concat_tables(tables)

    return rows.groupBy(*place, "group").cogroup(asked.groupBy(*place, "group")).applyInArrow(compare, "q long, c long, rep long, score double")


def _met(cosine: np.ndarray, level: np.ndarray, trees: int, chances: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The chance that some tree has vectors of that cosine share a prefix."""
    return 1 - (1 - np.interp(cosine, *chances) ** level) ** trees


def nearest_classes(classes: DataFrame, neighbours: int = NEIGHBOURS, trees: int = TREES, depth: int = DEPTH) -> DataFrame | None:
    """q, c, score: for each class that asks its neighbours + 1 nearest classes; None if none asks. classes: c, rep, v, asks; a written table."""
    spark = classes.sparkSession
    shape = classes.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", F.abs))).cast("double").alias("unit")).first()
    if not shape.n:
        return None
    if shape.least != shape.d:
        raise ValueError("vectors need one length")
    d, unit, most = shape.d, shape.unit, neighbours + 1
    # entries relative to the largest, so that squares neither overflow nor vanish together
    length = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + (x / unit) * (x / unit)))
    longest = classes.agg(F.max(length)).first()[0]
    chances = meeting(d + 1)
    drop: list[str] = []
    parts = max(1, -(-shape.n * trees // PART_ROWS))
    # written, as the sort looks at a sample first and would have all strings made twice
    entries = written(_entries(classes, d, unit, longest, trees, depth), "strings", drop)
    forest = written(_forest(entries, parts, depth), "forest", drop)
    places = _Places(forest.where("kind = 'ends'").select("part", "rows", "first", "last", "head", "tail", "head_tree", "tail_tree").collect(), depth)
    runs = written(_runs(forest, places, depth), "runs", drop)
    sizes = [F.sum(F.get("high", F.lit(k)) - F.get("low", F.lit(k))).alias(f"s{k}") for k in range(1, depth + 1)]
    start = F.coalesce(*[F.when(F.col(f"s{k}") >= START, F.lit(k)) for k in range(depth, 0, -1)], F.lit(1))
    state = runs.groupBy("c").agg(*sizes).select(F.col("c").alias("q"), start.alias("level"), F.lit(float("-inf")).alias("bar"))
    state = written(state, "state", drop)
    lengths = classes.where("asks").select(F.col("c").alias("q"), (length * (unit * unit * longest)).alias("scale"))

    @F.pandas_udf("double")
    def met(cosine, level):
        return cosine.__class__(_met(cosine.to_numpy(), level.to_numpy(), trees, chances))

    best = None
    while not state.isEmpty():
        found = _compared(forest, classes, _visits(runs, state, places), d, most)
        found = found if best is None else found.unionByName(best)
        pairs = found.groupBy("q", "c").agg(F.first("rep").alias("rep"), F.max("score").alias("score"))
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep", "c"))
        best = written(pairs.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth"), "nearest", drop)
        last = best.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        now = state.select("q", "level").join(last, "q", "left").join(lengths, "q")
        now = now.select("q", "level", F.when(F.col("n") >= most, F.col("low")).alias("low"), "scale")
        # with fewer neighbours than asked for there is no last one
        sure = F.col("low").isNotNull() & (met(F.least(F.coalesce(F.col("low") / F.col("scale"), F.lit(-1.0)), F.lit(1.0)), F.col("level")) >= REACH)
        left = now.where((F.col("level") > 0) & ~sure)
        state = written(left.select("q", (F.col("level") - 1).alias("level"), F.coalesce("low", F.lit(float("-inf"))).alias("bar")), "state", drop)
    result = written(best.select("q", "c", "score"), "neighbours") if best is not None else None
    forget(spark, drop)
    return result


_OUT = "query_id long, rank int, vec_id long, score double"


def nearest(table: DataFrame, asks: Column, neighbours: int = NEIGHBOURS, trees: int = TREES, depth: int = DEPTH, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the rows for which `asks` (of vec_id) holds: largest inner products first, ties to the smaller id."""
    spark = table.sparkSession
    small_batches(spark)
    drop: list[str] = []
    rows = written(usable(table, id_column, vector), "vectors", drop)
    named = written(classes_of(rows, neighbours), "classes", drop)
    queries = written(rows.where(asks).join(named.select("c", "v"), "v").select("vec_id", "c"), "queries", drop)
    asking = queries.select("c").distinct().withColumn("asks", F.lit(True))
    classes = written(named.join(asking, "c", "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "classes", drop)
    best = nearest_classes(classes, neighbours, trees, depth)
    if best is None:
        return spark.createDataFrame([], _OUT)
    # at most (neighbours + 1)^2 rows for a class that asks
    listed = best.join(classes.select("c", F.explode("members").alias("vec_id")), "c").select("q", F.struct((-F.col("score")).alias("minus"), "vec_id", (F.col("q") == F.col("c")).alias("own")).alias("x"))
    listed = listed.groupBy("q").agg(F.array_sort(F.collect_list("x")).alias("list"))
    joined = queries.select(F.col("vec_id").alias("query_id"), F.col("c").alias("q")).join(listed, "q")
    others = F.slice(F.filter("list", lambda x: ~(x["own"] & (x["vec_id"] == F.col("query_id")))), 1, neighbours)
    ranked = joined.select("query_id", F.posexplode(others).alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def op13_hash_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
