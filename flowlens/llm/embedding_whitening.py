"""Operator 11, embedding whitening by an exact integer scatter.

Entries become whole numbers, x = floor(scale * entry). Each distinct vector counts once in the fit. Partitions subtract
a shift and add up sums and cross-products; these are whole numbers of any size (digits to the base 2^30 whose sums Spark
keeps apart), so n·XᵀX - SSᵀ is exact, the same for every shift and every order of rows. Only then it becomes floating
point and is decomposed by eigh.

The driver holds the scatter matrix, whose size is that of the vectors' length squared, whatever the rows: more than
DIMENSIONS entries in a vector are an error. Every row and every vector is read; nothing is sampled.

Defined results: rows whose vector is null, empty, or holds a null or an entry that isn't finite take no part. Repeated
rows get a row each and count once in the fit. Numbers beyond 64 bits become the end of that range, as Spark's floor has
it. Vectors of several lengths have no common covariance and are an error. A component without variance (a single vector,
or fewer vectors than entries) has whitened 0 and explained 0 and isn't part of the identity error. An empty table gives
no rows. A deviation beyond what its type holds is null. Other columns are not used, whatever their names.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._shared import read_table, small_batches, written

SCALE, COMPONENTS, DIMENSIONS = 256, 4, 4096
#: Bits of a digit of the sums; so many digits hold the square of a 66-bit number over 2^40 rows.
_BASE, _DIGITS = 30, 7
#: Bits of a limb of a factor: products of two limbs over a batch's rows are exact in 64-bit floating point.
_LIMB = 20
#: Vectors whose medians make the shift. Any shift gives the same result; one near the middle keeps numbers short.
_SHIFT_ROWS = 101


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors of exact sums; components (by row) with variances, falling; total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def factors(self) -> np.ndarray:
        """1 over each component's standard deviation; 0 where there is no variance."""
        return np.where(self.variances > 0, 1 / np.sqrt(np.where(self.variances > 0, self.variances, 1)), 0.0)


def whole(table: DataFrame, scale: int = SCALE, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x: the rows that take part and their vectors as whole numbers."""
    c = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.where(c.isNotNull()).where((F.size(c) > 0) & finite)
    return rows.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("x"))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows by entries of an Arrow list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Exact floating-point parts of whole numbers (64-bit or Python's), the lowest _LIMB bits first."""
    parts = []
    while True:
        if y.dtype != object and (not y.size or -(1 << _LIMB) <= y.min() <= y.max() < 1 << _LIMB):
            return [*parts, y.astype(np.float64)]
        low = y & ((1 << _LIMB) - 1)
        parts.append(low.astype(np.float64))
        y = y >> _LIMB
        if y.dtype == object and all(-(1 << 62) < v < 1 << 62 for v in y.flat):
            y = y.astype(np.int64)


def _scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of rows as Python's whole numbers. At most 2^11 rows at a time, so that float sums are exact."""
    d = y.shape[1]
    sums, cross = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(y), 1 << 11):
        limbs = _limbs(y[at : at + (1 << 11)])
        for i, a in enumerate(limbs):
            sums += a.sum(axis=0).astype(np.int64).astype(object) * (1 << _LIMB * i)
            for j, b in enumerate(limbs):
                cross += (a.T @ b).astype(np.int64).astype(object) * (1 << _LIMB * (i + j))
    return sums, cross


def _shifted(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift, in 64 bits where that is sure to be enough."""
    if x.size and (max(abs(int(x.min())), abs(int(x.max()))) + int(np.abs(shift.astype(object)).max())) >= 1 << 62:
        return x.astype(object) - shift.astype(object)
    return x - shift


def fitted(x: DataFrame) -> Whitening | None:
    """The whitening of x (a frame of `whole`'s distinct vectors: one column x); None without vectors."""
    some = [r.x for r in x.limit(_SHIFT_ROWS).collect()]
    if not some:
        return None
    lengths = [r.d for r in x.select(F.size("x").alias("d")).distinct().limit(2).collect()]
    if len(lengths) > 1 or lengths[0] > DIMENSIONS:
        raise ValueError(f"vectors need one length of at most {DIMENSIONS}")
    d = lengths[0]
    shift = np.array([sorted(v)[len(some) // 2] for v in zip(*some, strict=True)], np.int64)
    upper = np.triu_indices(d)
    digits = ", ".join(f"d{k} long" for k in range(_DIGITS))

    def count(batches):
        n, sums, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            s, c = _scatter(_shifted(_matrix(batch.column(0), d), shift))
            n, sums, cross = n + len(batch), sums + s, cross + c
        if n:
            # row -1: n and sums; others: the upper half of the cross-products
            i = np.concatenate([[-1], np.full(d, -1), upper[0]])
            j = np.concatenate([[-1], np.arange(d), upper[1]])
            rest, columns = np.concatenate([np.array([n], object), sums, cross[upper]]), []
            for k in range(_DIGITS):
                columns.append(pa.array((rest & ((1 << _BASE) - 1) if k < _DIGITS - 1 else rest).astype(np.int64)))
                rest = rest >> _BASE
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(i[part]), pa.array(j[part]), *[c[part] for c in columns]], ["i", "j", *[f"d{k}" for k in range(_DIGITS)]])

    parts = x.select("x").mapInArrow(count, f"i long, j long, {digits}").groupBy("i", "j").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(_DIGITS)])
    n, sums, cross = 0, [0] * d, np.zeros((d, d), object)
    for r in parts.toLocalIterator():
        value = sum(int(r[2 + k]) << (_BASE * k) for k in range(_DIGITS))
        if r.i >= 0:
            cross[r.i, r.j] = cross[r.j, r.i] = value
        elif r.j >= 0:
            sums[r.j] = value
        else:
            n = value
    s = np.array(sums, object)
    # true division of Python's whole numbers rounds once
    scatter = (n * cross - np.outer(s, s)) / (n * n)
    covariance = scatter.astype(np.float64)
    variances, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-variances, kind="stable")
    variances, vectors = variances[order], vectors[:, order].T
    trace = float(sum(covariance.diagonal()))
    # what rounding leaves of a variance of 0
    variances = np.where(variances > trace * d * np.finfo(float).eps, variances, 0.0)
    largest = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.sign(vectors[np.arange(d), largest])[:, None]
    return Whitening(n, tuple(int(a) + n * int(b) for a, b in zip(sums, shift, strict=True)), vectors, variances, trace)


def _centred(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """n·x - S, exact: in 64 bits where that is sure to be enough."""
    s = np.array(fit.sums, object)
    most = max(abs(int(x.min())), abs(int(x.max()))) * fit.n + max(abs(v) for v in fit.sums)
    if most < 1 << 62:
        return x * fit.n - s.astype(np.int64)
    return x.astype(object) * fit.n - s


def _squares(y: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    if y.dtype != object and y.shape[1] * int(np.abs(y).max()) ** 2 < 1 << 62:
        return (y * y).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in y.tolist()]


def _projections(y: np.ndarray, fit: Whitening, components: int) -> np.ndarray:
    whitener = fit.components[:components] * fit.factors[:components, None]
    return (y / fit.n).astype(np.float64) @ whitener.T


def identity_error(x: DataFrame, fit: Whitening, components: int = COMPONENTS) -> float:
    """The largest absolute entry of the covariance of x's whitened vectors minus the identity, over the components with variance."""
    m, d = min(components, len(fit.sums)), len(fit.sums)
    known = [k for k in range(m) if fit.variances[k] > 0]
    if not known:
        return 0.0

    def project(batches):
        for batch in batches:
            if len(batch):
                z = _projections(_centred(_matrix(batch.column(0), d), fit), fit, m)
                yield pa.RecordBatch.from_arrays([pa.array(z[:, k]) for k in range(m)], [f"c{k}" for k in range(m)])

    z = x.select("x").mapInArrow(project, ", ".join(f"c{k} double" for k in range(m)))
    pairs = [(a, b) for a in known for b in known if a <= b]
    row = z.agg(*[F.covar_pop(f"c{a}", f"c{b}") for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(row, pairs, strict=True))


_OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, fit: Whitening, components: int = COMPONENTS, error: float | None = None) -> DataFrame:
    """A row for each row of `rows` (vec_id, x) and component: deviation is the sum of squares of n·x - S."""
    m, d = min(components, len(fit.sums)), len(fit.sums)
    explained = fit.variances[:m] / fit.trace if fit.trace > 0 else np.zeros(m)

    def project(batches):
        for batch in batches:
            if not len(batch):
                continue
            k = len(batch)
            y = _centred(_matrix(batch.column(1), d), fit)
            deviation = pa.array([decimal.Decimal(v) if v < 10**38 else None for v in _squares(y)], pa.decimal128(38, 0))
            take = pa.array(np.repeat(np.arange(k), m))
            columns = [
                batch.column(0).take(take), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, fit.n)), deviation.take(take),
                pa.array(_projections(y, fit, m).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, np.nan if error is None else error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _OUT.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(project, _OUT)


def whitening(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The whitened rows of a table of vectors, fitted on its distinct vectors."""
    spark = table.sparkSession
    small_batches(spark)
    rows = whole(table, scale, id_column, vector)
    # copies meet before the shuffle, so a vector that many rows share costs a row for each task
    distinct = written(rows.select("x").distinct(), "vectors")
    fit = fitted(distinct)
    if fit is None:
        return spark.createDataFrame([], _OUT)
    return whitened(rows, fit, components, identity_error(distinct, fit, components))


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitening(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))
