"""Operator 8, best-fit packing with certified bounds.

Texts become token ids; a text of more than LENGTH ids is cut into pieces of LENGTH, of which only the first may be
shorter. Full pieces are sequences of their own. The others are dealt to partitions by hash, and each partition packs
its share by best-fit decreasing. Dual feasible functions give each partition a lower bound of its bin count; a
partition whose count meets the bound is certified. Bins that are full to the brim are settled for good; partitions
with a gap put their other bins' pieces into a pool, certified ones the pieces of their emptiest bin. The pool is
dealt to fewer partitions and packed again, until one partition's worth is left or a round gains nothing.

Ids are those of the tokenizers library for the same vocabulary (tests hold them against it), by way of a faster
library that is given whole texts: to remember words' ids takes more time, as most words are met once. The query and
the stage cut texts at the added tokens of the vocabulary's json first, as that library does by default; `pieces` takes
their strings as ordinary text unless it is given them.

Defined results: a null text is an empty one, so its only id is the end id. Any text has its ids, runs of millions of
spaces, line feeds or letters too. Equal rows are packed one by one. Of a
stage's or query's other columns none is used.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._shared import read_table, small_batches, written

LENGTH, END = 1024, 2
#: Pieces that one partition packs at once.
PART_ROWS = 100_000


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The strings that the vocabulary's json adds to its merges, and their ids."""
    with open(path or _public("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("only added tokens that match as they stand are supported")
    return {t["content"]: t["id"] for t in added}


#: Runs of white space that are too long for the pattern's look-ahead, which keeps a state for each character.
LONG_RUN = 10_000
_SPACES = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")


class _Ids:
    """A text's ids as little-endian unsigned 32-bit numbers.

    The pattern takes a run of white space as one piece, but for its last character if a word follows; long runs are
    given to the merges in just that way.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("flowlens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        ids, at = [], 0
        for run in _SPACES.finditer(text) if len(text) >= LONG_RUN else ():
            last = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.encoding.encode_ordinary(text[at : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : last])
            at = last
        return np.array(ids + self.encoding.encode_ordinary(text[at:]), "<u4").tobytes()


def _with_added(plain: _Ids, added: dict[str, int]):
    """A function of a text to its ids; of added tokens that begin at one place the longest is taken."""
    if not added:
        return plain
    found = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    whole = {token: np.array([i], "<u4").tobytes() for token, i in added.items()}

    def ids(text: str) -> bytes:
        if not any(token in text for token in whole):
            return plain(text)
        # odd parts are the tokens
        return b"".join(whole[part] if k % 2 else plain(part) for k, part in enumerate(found.split(text)) if part)

    return ids


@cache
def _ids(ranks_path: str, pattern: str) -> _Ids:
    """One for each worker."""
    return _Ids(ranks_path, pattern)


def pieces(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, length: int = LENGTH, end: int = END, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text's pieces. added: strings that are one id wherever they stand."""
    small_batches(docs.sparkSession)
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    ranks_path = ranks_path or _public("byte_bpe_50k.tiktoken")
    last = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        ids_of = _with_added(_ids(ranks_path, pattern), added or {})
        for batch in batches:
            rows: list[list[int]] = [[], [], [], []]
            owner = []
            for i, text in enumerate(batch.column("text")):
                ids = ids_of(text.as_py() or "") + last
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    to = at + ((n % length or length) if k == 0 else length)
                    for column, value in zip(rows, (k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])), strict=True):
                        column.append(value)
                    owner.append(i)
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(rows[0], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[1:]]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, taken in falling order, each into the fullest bin with room for it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set if some bin has r left
    bins = np.zeros(len(sizes), np.int64)
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            b, r, n = n, capacity, n + 1
        bins[i] = b
        if r > s:
            room[r - s].append(b)
            free |= 1 << (r - s)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the largest of two families of dual feasible functions' sums.

    f_t counts sizes over capacity - t as whole bins, those under t as nothing, others by size. u_k maps a size s to
    floor((k + 1) s / capacity) / k unless (k + 1) s / capacity is whole, then to s / capacity.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    s = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * s).sum()) // capacity)
    below, weight = np.cumsum(count), np.cumsum(count * s)
    t = np.arange(1, capacity // 2 + 1)
    big = below[-1] - below[capacity - t]
    best = max(best, int((big + -(-(weight[capacity - t] - weight[t - 1]) // capacity)).max()))
    for k in range(1, 101):
        whole = (k + 1) * s % capacity == 0
        parts = np.where(whole, k * s, (k + 1) * s // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * parts).sum()) // (k * capacity)))
    return best


_BIN = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, settled boolean, gap long"


def _pack(rows: DataFrame, parts: int, number: int, length: int, final: bool) -> DataFrame:
    """Packs rows in `parts` partitions. settled: the bin stays as it is."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def pack(batches):
        from pyspark import TaskContext

        part = (number << 24) + TaskContext.get().partitionId()
        table = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches], schema)
        if not len(table):
            return
        table = table.sort_by([("length", "descending"), *[(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")]])
        sizes = table["length"].to_numpy()
        bins = best_fit_decreasing(sizes, length)
        fill = np.bincount(bins, sizes).astype(np.int64)
        gap = len(fill) - lower_bound(sizes, length)
        settled = (fill == length) if gap else np.arange(len(fill)) != int(fill.argmin())
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - sizes[order] - np.concatenate([[0], np.cumsum(fill)[:-1]])[bins[order]]
        for name, column in (("part", np.full(len(bins), part)), ("bin", bins), ("offset", offset), ("settled", settled[bins] | final), ("gap", np.full(len(bins), gap))):
            table = table.append_column(name, pa.array(column))
        yield from table.to_batches()

    dealt = rows.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(parts, F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(number)))
    return dealt.mapInArrow(pack, _BIN)


def packed(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows (a frame of `pieces`) with sequence_id, offset and gap (bins over the lower bound in the
    partition that settled it, 0: certified); two shuffles of a row of numbers for each piece at most."""
    rows = written(rows, "pieces")
    out = rows.where(F.col("length") == length).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap"))
    pool, count, number = rows.where(F.col("length") < length), None, 1
    while True:
        left = pool.count()
        if not left:
            break
        parts = max(1, -(-left // PART_ROWS)) if number == 1 else max(1, min(parts - 1, -(-left // PART_ROWS)))
        # sequence ids have 13 bits for rounds, 24 for partitions and 26 for bins
        final = parts == 1 or (count is not None and left >= count) or number == (1 << 13) - 1
        tried = written(_pack(pool, parts, number, length, final), "packed")
        done = tried.where("settled").select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("part") * (1 << 26) - F.col("bin")).alias("sequence_id"), "offset", "gap")
        out = out.unionByName(done)
        if final:
            break
        pool, count, number = tried.where("not settled"), left, number + 1
    return out


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(pieces(read_table(spark, sf_dir, "documents"), added=added_tokens()))


def packed_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of docs and their places in sequences."""
    return packed(pieces(docs, added=added_tokens()))
