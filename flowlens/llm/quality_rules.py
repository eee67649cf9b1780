"""Operator 3, quality rules: base rules, then robust multivariate outliers by language and source.

Five transformed statistics of each document that passes the base rules (FEATURES) form a vector. For every
(language, source), for every language and for all documents, a minimum-covariance-determinant estimate is made over
all rows: from three starts (median deviations alone, with the correlations of tanh scores, with spatial signs),
concentration steps re-estimate mean and covariance from the h = (n + 6) / 2 rows nearest to the last estimate, until
the determinant stops falling; the smallest determinant counts. Its estimate breaks down only when nearly half of a
group is junk. One reweighting step then estimates from all rows within the 0.975 quantile. A document is rejected if
its squared Mahalanobis distance exceeds CUTOFF, the 0.999 quantile of chi-square with five degrees; groups of under
MIN_ROWS rows use their language's estimate, then that of all documents; below MIN_ALL rows nothing is rejected.

Symbols, repeated lines and repeated words are 0 in most prose, so half of a group has no variance there and the plain
estimate is singular. It is mended where it is singular, and only there: in units of the standard deviations beside the
statistics in FEATURES, a covariance's eigenvalues under 1 become 1. So its condition number is at most its largest
eigenvalue; directions that vary by themselves keep their own variance and correlations, and in the others a document is
rejected at 4.53 of these deviations (about 3 per cent of symbols, three repeated lines, half of the words repeated, where
the base rule takes over).

Vectors are rounded to 1/SCALE and distances to bins, so a group needs few distinct values: medians and the h-th
distance are exact over any number of rows, sums are whole numbers, and each step is one pre-aggregated shuffle.

Defined results: a null or empty text has no words, all counts 0, base_failed true and kept false. Null languages and
sources are groups of their own. Repeated rows are judged alike; other columns pass through the stage untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm._shared import read_table, sized, small_batches, written
from flowlens.llm._words import SPACES, mix, slices, utf8, word_hashes

STATS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
#: Transformed statistics and the least standard deviation that each is credited with; the mean length of 50 words varies by
#: 0.06 or so.
FEATURES = [
    ("ln(_stats.n_words)", 0.3),
    ("ln(_stats.word_chars / _stats.n_words)", 0.06),
    ("ln(1 + 100 * _stats.n_symbols / _stats.word_chars)", 0.3),
    ("ln(1 + _stats.n_dup_lines)", 0.3),
    ("_stats.n_repeat_words / _stats.n_words", 0.1),
]
SCALE, BINS = 256, 64
#: Chi-square quantiles with 5 degrees: 0.975 (reweighting) and 0.999 (rejection); and what makes the covariances of the
#: nearest half and of the nearest 0.975 of normal vectors right. A fall of the log determinant by less than FALL is none.
WEIGHED, CUTOFF, HALF, MOST, FALL = 12.8325, 20.5150, 1.9122, 1.0556, 0.001
MIN_ROWS, MIN_ALL = 50, 20
#: Estimates of so many groups at most (three starts, 300 bytes each) are broadcast to the rows.
KEYS = 20_000
_D = len(FEATURES)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_ANY = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64)
_ANY[10] = 0


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words in 3-word windows that their text holds twice or more, for each row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(words) < 3:
        return np.zeros(len(first) - 1, np.int64)
    window = np.flatnonzero(row[2:] == row[:-2])
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    keys = mix(mix(words[window] * a + words[window + 1] * b + words[window + 2] * c) + row[window].astype(np.uint64) * a)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[window[twice] + i] = True
    return _per_row(covered, first)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, for each row."""
    starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(data))
    word = np.logical_or.reduceat(~SPACES[data], starts)
    place = (np.arange(len(data), dtype=np.int64) - np.repeat(starts, ends - starts)).astype(np.uint64)
    keys = mix(np.add.reduceat(mix(_ANY[data] + place) * (data != 10), starts) + mix(row.astype(np.uint64)))[word]
    row = row[word]
    order = np.argsort(keys, kind="stable")
    later = order[1:][keys[order][1:] == keys[order][:-1]]
    return np.bincount(row[later], minlength=len(offsets) - 1)


def text_stats(column: pa.Array) -> pa.Array:
    """The base statistics of each text of an Arrow string column."""
    out = [[] for _ in NAMES]
    for _, part in slices(column):
        data, offsets = utf8(part)
        words, first = word_hashes(part, fold=False)
        inside = ~SPACES[data]
        for to, found in zip(out, (np.diff(first), _per_row(inside & ((data & 0xC0) != 0x80), offsets), _per_row(_SYMBOL[data], offsets), _repeated_lines(data, offsets), _repeated(words, first)), strict=True):
            to.append(found)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in out], NAMES)


def with_stats(docs: DataFrame) -> DataFrame:
    """docs and a struct column _stats; only the text goes to Python."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(STATS)
    def stats(text: pa.Array) -> pa.Array:
        return text_stats(text)

    failed = F.expr("_stats.n_words < 50 or 100 * _stats.n_repeat_words > 50 * _stats.n_words")
    return docs.withColumn("_stats", stats("text")).withColumn("_failed", failed)


def _rounded() -> list:
    return [F.expr(f"cast(round({SCALE} * {e}) as double)").alias(f"x{i}") for i, (e, _) in enumerate(FEATURES)]


_X = [f"x{i}" for i in range(_D)]
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
_SUMS = [*[f"s{i}" for i in range(_D)], *[f"p{i}{j}" for i, j in _PAIRS]]
_LEAST = np.array([f * SCALE for _, f in FEATURES])
_MODEL = "key struct<level:int,lang:string,source:string>, n long, start int, mean array<double>, inverse array<double>, determinant double, last double"


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)


def _symmetric(products: np.ndarray) -> np.ndarray:
    out = np.zeros((len(products), _D, _D))
    for k, (i, j) in enumerate(_PAIRS):
        out[:, i, j] = out[:, j, i] = products[:, k]
    return out


def credited(cov: np.ndarray) -> np.ndarray:
    """Covariances with at least the variance of FEATURES in every direction."""
    if not len(cov):
        return cov
    unit = np.outer(_LEAST, _LEAST)
    values, vectors = np.linalg.eigh(cov / unit)
    return (vectors * np.maximum(values, 1.0)[:, None, :]) @ vectors.transpose(0, 2, 1) * unit


def _model(batch: pa.RecordBatch, n, start, mean: np.ndarray, cov: np.ndarray, last) -> pa.RecordBatch:
    inverse = np.linalg.inv(cov) if len(cov) else cov
    determinant = np.linalg.slogdet(cov)[1] if len(cov) else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [batch.column("key"), n, pa.array(start, pa.int32()), _lists(mean), _lists(inverse.reshape(len(cov), _D * _D)), pa.array(determinant, pa.float64()), pa.array(last, pa.float64())],
        ["key", "n", "start", "mean", "inverse", "determinant", "last"],
    )


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """key, n, start, last, c and sums of x and of products to means and inverse covariances, in units of 1/SCALE."""

    def fit(batches):
        for batch in batches:
            c = _columns(batch, ["c"])
            mean, square = _columns(batch, [f"s{i}" for i in range(_D)]) / c, _symmetric(_columns(batch, [f"p{i}{j}" for i, j in _PAIRS]) / c)
            cov = credited(factor * (square - mean[:, :, None] * mean[:, None, :]))
            yield _model(batch, batch.column("n"), batch.column("start"), mean, cov, batch.column("last"))

    return sums.mapInArrow(fit, _MODEL)


def _distance(x: list[str]) -> F.Column:
    terms = []
    for i, j in _PAIRS:
        a, b = (F.col(x[k]) - F.col("mean")[k] for k in (i, j))
        terms.append((1.0 if i == j else 2.0) * a * b * F.col("inverse")[i * _D + j])
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _sums() -> list:
    return [F.count("*").alias("c"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(_X)], *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"p{i}{j}") for i, j in _PAIRS]]


def _starts(rows: DataFrame, keys: int) -> tuple[DataFrame, int]:
    """Three estimates of each group, and the number of groups."""
    middle = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.percentile(c, F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(_X)])
    middle = written(middle, "medians")
    few = middle.count()
    off = rows.join(sized(middle.drop("n"), few, keys), "key").select("key", *[F.abs(F.col(c) - F.col(f"m{i}")).alias(c) for i, c in enumerate(_X)])
    spread = off.groupBy("key").agg(*[F.percentile(c, F.lit(0.5)).alias(f"d{i}") for i, c in enumerate(_X)])
    deviations = [F.greatest(1.4826 * F.col(f"d{i}"), F.lit(float(_LEAST[i]))).alias(f"d{i}") for i in range(_D)]
    middle = written(middle.join(spread, "key").select("key", "n", *[f"m{i}" for i in range(_D)], *deviations), "spreads")
    z = rows.join(sized(middle, few, keys), "key").select("key", *[((F.col(c) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(c) for i, c in enumerate(_X)])
    far = F.greatest(F.sqrt(sum((F.col(c) * F.col(c) for c in _X[1:]), F.col(_X[0]) * F.col(_X[0]))), F.lit(1e-9))
    z = z.select("*", far.alias("far"))
    products = lambda f, name: [F.avg(f(i) * f(j)).alias(f"{name}{i}{j}") for i, j in _PAIRS]
    scores = z.groupBy("key").agg(*[F.avg(F.tanh(c)).alias(f"a{i}") for i, c in enumerate(_X)], *products(lambda i: F.tanh(_X[i]), "t"), *products(lambda i: F.col(_X[i]) / F.col("far"), "u"))

    def begin(batches):
        for batch in batches:
            mean, sd, mid = (_columns(batch, [f"{c}{i}" for i in range(_D)]) for c in "mda")
            tanh, sign = (_symmetric(_columns(batch, [f"{c}{i}{j}" for i, j in _PAIRS])) for c in "tu")
            scale = sd[:, :, None] * sd[:, None, :]
            # 0.394: the variance of tanh of a standard normal number
            for k, cov in enumerate((np.eye(_D)[None] * scale, credited((tanh - mid[:, :, None] * mid[:, None, :]) / 0.394 * scale), credited(_D * sign * scale))):
                yield _model(batch, batch.column("n"), np.full(len(mean), k), mean, cov, np.full(len(mean), np.inf))

    return middle.join(scores, "key").mapInArrow(begin, _MODEL), few


def fit(rows: DataFrame, keys: int = KEYS) -> DataFrame:
    """The estimates of all groups; rows: lang, source, x0.. of documents that pass the base rules.

    Estimates of up to `keys` groups are broadcast to the rows; beyond that they are joined by a shuffle.
    """
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.cast("string").alias("lang"), source.cast("string").alias("source"))
    none = F.lit(None)
    rows = rows.select(F.explode(F.array(level(0, F.col("lang"), F.col("source")), level(1, F.col("lang"), none), level(2, none, none))).alias("key"), *_X)
    model, few = _starts(rows, keys)
    model, found = written(model, "starts"), []
    # ends: each step lowers the log determinant by FALL at least, and the least variances bound it from below
    while not model.isEmpty():
        near = rows.join(sized(model, few, keys), "key").select("key", "n", "start", "determinant", *_X, F.floor(BINS * F.log1p(_distance(_X))).alias("bin"))
        # the starts' own determinants are of another kind and don't count
        last = F.col("determinant") if found else F.lit(float("inf"))
        sums = near.groupBy("key", "n", "start", last.alias("last"), "bin").agg(*_sums())
        before = Window.partitionBy("key", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        nearest = sums.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).where("before < (n + 6) div 2")
        nearest = nearest.groupBy("key", "n", "start", "last").agg(*[F.sum(c).alias(c) for c in ("c", *_SUMS)])
        found.append(written(_estimates(nearest, HALF), "model"))
        model = found[-1].where(F.col("determinant") < F.col("last") - FALL)
    if not found:
        return model
    steps = found[0].withColumn("step", F.lit(0))
    for k, step in enumerate(found[1:], 1):
        steps = steps.unionByName(step.withColumn("step", F.lit(k)))
    best = steps.groupBy("key", "n").agg(F.min_by(F.struct("mean", "inverse"), F.struct("determinant", "start", "step")).alias("e")).select("key", "n", "e.mean", "e.inverse")
    best = written(best, "model")
    weighed = rows.join(sized(best, few, keys), "key").where(_distance(_X) <= WEIGHED)
    sums = weighed.groupBy("key", "n", F.lit(0).alias("start"), F.lit(0.0).alias("last")).agg(*_sums())
    return written(_estimates(sums, MOST).select("key", "n", "mean", "inverse"), "model")


def judged(stats: DataFrame, model: DataFrame, keys: int = KEYS) -> DataFrame:
    """stats (a frame of with_stats) with the column _kept."""
    pick = lambda k, least: model.where((F.col("key.level") == k) & (F.col("n") >= least)).select(F.col("key.lang").alias(f"l{k}"), F.col("key.source").alias(f"s{k}"), F.struct("mean", "inverse").alias(f"e{k}"))
    groups = model.where("key.level = 0").select(F.col("key.lang").alias("_lang"), F.col("key.source").alias("_source"))
    g = groups.join(pick(0, MIN_ROWS), F.col("_lang").eqNullSafe(F.col("l0")) & F.col("_source").eqNullSafe(F.col("s0")), "left")
    g = g.join(pick(1, MIN_ROWS), F.col("_lang").eqNullSafe(F.col("l1")), "left").withColumn("_all", F.lit(2)).join(F.broadcast(pick(2, MIN_ALL).withColumn("k2", F.lit(2))), F.col("_all") == F.col("k2"), "left")  # one row
    g = written(g.select("_lang", "_source", F.coalesce("e0", "e1", "e2").alias("_e")).select("_lang", "_source", F.col("_e.mean").alias("mean"), F.col("_e.inverse").alias("inverse")), "estimates")
    names = stats.columns
    x = [f"_x{i}" for i in range(_D)]
    rows = stats.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("lang").cast("string").alias("_l"), F.col("source").cast("string").alias("_s"), F.col("_stats"), F.col("_failed"))
    rows = rows.select("*", *[F.when(~F.col("_failed"), c).alias(a) for c, a in zip(_rounded(), x, strict=True)])
    rows = rows.join(sized(g, g.count(), keys), F.col("_l").eqNullSafe(F.col("_lang")) & F.col("_s").eqNullSafe(F.col("_source")), "left")
    kept = F.when(F.col("_failed"), False).otherwise(F.coalesce(_distance(x) <= CUTOFF, F.lit(True)))
    return rows.select("_row.*", kept.alias("_kept"))


def _model_of(stats: DataFrame) -> DataFrame:
    rows = stats.where("not _failed").select("lang", "source", "_stats").select("lang", "source", *_rounded())
    return fit(rows)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = written(with_stats(docs).drop("text"), "stats")
    out = judged(stats, _model_of(stats))
    return out.select("doc_id", *[F.col(f"_stats.{c}") for c in NAMES], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def quality_kept(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep. Texts are read twice, which costs less than shuffling them."""
    columns = docs.columns
    stats = with_stats(docs)
    model = _model_of(written(stats.select("lang", "source", "_stats", "_failed"), "stats"))
    return judged(stats, model).where("_kept").select(*[F.col(f"`{c}`") for c in columns])
