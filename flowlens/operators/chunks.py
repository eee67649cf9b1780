"""Orders of a key's rows without a window over all of them: windows run within chunks of time, and what a chunk needs of those
before it comes from totals of the chunks, which are aggregated first. A key with all rows is as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys that may be null; the right side holds a key once."""
    right = right.select(*[F.col(c).alias(f"_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return left.join(right, on, "left").drop(*[f"_{c}" for c in keys])


def chunked(rows: DataFrame, at: str, chunk: int) -> DataFrame:
    """rows with _chunk, the number of their chunk of time (at: a whole number)."""
    return rows.withColumn("_chunk", F.expr(f"(`{at}` - pmod(`{at}`, {chunk}L)) div {chunk}L"))


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def with_previous(rows: DataFrame, keys: list[str], at: str, tie: str, name: str = "_previous") -> DataFrame:
    """rows (with _chunk) and the time of the row before, in order of (at, tie), of the same keys."""
    ends = rows.groupBy(*keys, "_chunk").agg(F.max(at).alias("_last"))
    ends = ends.select(*keys, "_chunk", F.max("_last").over(_earlier(keys)).alias("_carried"))
    own = F.lag(at).over(Window.partitionBy(*keys, "_chunk").orderBy(at, tie))
    return same(rows.withColumn("_own", own), ends, [*keys, "_chunk"]).withColumn(name, F.coalesce("_own", "_carried")).drop("_own", "_carried")


def with_running(rows: DataFrame, keys: list[str], at: str, tie: str, value: Column, name: str, to: int = Window.currentRow) -> DataFrame:
    """rows (with _chunk) and the sum of value over the rows up to `to` (-1: those before), in order of (at, tie)."""
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*keys, "_chunk", F.sum("_sum").over(_earlier(keys)).alias("_carried"))
    within = F.sum("_value").over(Window.partitionBy(*keys, "_chunk").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, to))
    rows = same(rows.withColumn("_own", within), sums, [*keys, "_chunk"])
    return rows.withColumn(name, F.coalesce("_own", F.lit(0)) + F.coalesce("_carried", F.lit(0))).drop("_own", "_carried", "_value")


def with_latest(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """rows (with _chunk) and the greatest mark (a frame of keys, at) of their keys that is not after them."""
    marks = marks.select(*keys, "_chunk", at).distinct()
    last = marks.groupBy(*keys, "_chunk").agg(F.max(at).alias("_last"))
    chunks = last.unionByName(rows.select(*keys, "_chunk").distinct(), allowMissingColumns=True).groupBy(*keys, "_chunk").agg(F.max("_last").alias("_last"))
    chunks = chunks.select(*keys, "_chunk", F.max("_last").over(_earlier(keys)).alias("_carried"))
    tagged = rows.select(*keys, "_chunk", at, F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    both = tagged.unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_chunk").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_own", F.max(F.when(F.col("_row").isNull(), F.col(at))).over(upto)).where(F.col("_row").isNotNull())
    both = same(both, chunks, [*keys, "_chunk"])
    return both.select("_row.*", F.coalesce("_own", "_carried").alias(name))


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with all of a key in one partition. By a hash of the keys and not by the keys themselves: where a join has dealt by
    those, Spark leaves the repartition out, and may then read the join's shuffle by other partitions."""
    return rows.repartition(F.xxhash64(*keys))


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _differ(before: pa.Array, after: pa.Array) -> np.ndarray:
    """Where keys differ; nulls are alike."""
    unequal = pc.fill_null(pc.not_equal(before, after), True)
    return pc.and_not(unequal, pc.and_(pc.is_null(before), pc.is_null(after))).to_numpy(zero_copy_only=False)


def _begins(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Of a batch's rows but the first, whether they have other keys than the row before."""
    found = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in keys:
        column = batch.column(k)
        found |= _differ(column[:-1], column[1:])
    return found


def in_groups(rows: DataFrame, keys: list[str], at: str, work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """The rows that work returns of Arrow tables of whole groups, in order of (keys, at), and of their groups' numbers.

    keys: whole numbers, texts and the like. A table holds as many groups as an Arrow batch, so a group costs no call of its
    own; one that is longer than a batch is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            if table.num_rows:
                group = np.append(0, np.cumsum(_begins(table.to_batches()[0], keys)))
                yield from work(table, group).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.flatnonzero(_begins(batch, keys)) + 1
            if held and any(_differ(held[-1].column(k)[-1:], batch.column(k)[:1])[0] for k in keys):
                cuts = np.append(0, cuts)
            if len(cuts):
                cut = int(cuts[-1])
                yield from told([*held, batch.slice(0, cut)])
                held = []
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield from told(held)

    return dealt(rows, keys).sortWithinPartitions(*keys, at).mapInArrow(run, schema)
