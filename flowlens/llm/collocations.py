"""Operator 12, phrase collocations by hierarchical pair naming.

Texts are lower-cased (A-Z) and cut at punctuation and line ends into pieces, pieces at spaces and tabs into words. Level 1
names the frequent words of a language. Level k counts adjacent names of level k-1, names the pairs that are frequent
(every part of a frequent phrase is frequent, so nothing is missed) and puts these names in the place of the pairs. A
name's pair of ids is also its pair of parents: the phrase without its last and without its first word. Frequencies of
all the parts that a cut leaves, and the longer phrases that hold a phrase, are read off those pointers.

Texts are held as blocks: local codes of a few megabytes of text of one language, and the local codes' global names. Per
level, distinct pairs of a block are counted in the block, summed over all blocks, and the frequent ones come back to the
block by a join on the pair. No row stands for an occurrence, so a word in every text costs a row for each block. Pairs
that a filter of BITS bits shows to be rare aren't sent to that join; the filter's size is fixed, and it never holds back
a frequent pair.

The best phrases of a language are taken from a range-partitioned sort by the totals before each partition, so that no
task holds a language.

Defined results: null texts are empty; a null language is `und`. Languages without a candidate give no row. Repeated rows
count each time. Long texts are one block, however long. Other columns are not used. Within a block words are told apart
by a 64-bit hash, across blocks by their text. A frequency of 10^15 or more is an error (scores are exact to 38 digits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm._shared import forget, read_table, small_batches, written
from flowlens.llm._words import _FOLDED, _factors, mix, slices, utf8

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bits of the filter of frequent pairs, whatever their number.
BITS = 1 << 27
#: A row is a whole block: few of them to a row group.
_ROW_GROUPS = {"parquet.block.size": 16 << 20}

_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_VALUE = np.where(_SPACE | _BREAK, np.uint64(0), _FOLDED)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: hash, first byte, end, row, and a number that words of one piece share and no others."""
    data, offsets = utf8(column)
    inside = ~(_SPACE | _BREAK)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, starts, starts
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_BREAK[data])[starts] + row
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    # bytes after a word's end count nothing
    longest = int((ends - starts).max())
    values = _VALUE[data[starts[0] :]] * _factors(longest)[np.minimum(place, longest - 1)]
    return mix(np.add.reduceat(values, starts - starts[0])), starts, ends, row, piece


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower-cased bytes between starts and ends as a string column."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(_LOWER[data[at]].tobytes())).cast(pa.string())


def _packed(codes: np.ndarray) -> bytes:
    """Codes (frequent ones small) by planes of bytes, compressed."""
    width = max(1, (int(codes.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T)
    return len(codes).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    codes = np.zeros((n, 4), np.uint8)
    codes[:, :width] = planes.T
    return codes.view("<u4").ravel()


def _by_count(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in falling order of their counts, and each number's place in that order."""
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return order, place


_BLOCK = "block long, lang string, words array<string>, counts array<long>, codes binary"


def _blocks_of(text: pa.Array, lang: pa.Array) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(lang, distinct words, their counts, codes): codes are words' numbers from 1 in text order, 0 between pieces."""
    found = [_words(part) for _, part in slices(text)]
    data, offsets = utf8(text)
    at = [i for i, _ in slices(text)]
    hashes = np.concatenate([f[0] for f in found])
    starts, ends = (np.concatenate([f[k] + offsets[i] for i, f in zip(at, found, strict=True)]) for k in (1, 2))
    row = np.concatenate([f[3] + i for i, f in zip(at, found, strict=True)])
    piece, last = [], 0
    for f in found:
        piece.append(f[4] + last)
        last += int(f[4][-1]) + 1 if len(f[4]) else 0
    piece = np.concatenate(piece)
    of = lang.dictionary_encode()
    code = of.indices.to_numpy(zero_copy_only=False)[row]
    for k, name in enumerate(of.dictionary.to_pylist()):
        mine = np.flatnonzero(code == k)
        if not len(mine):
            continue
        _, first, number, counts = np.unique(hashes[mine], return_index=True, return_inverse=True, return_counts=True)
        cut = np.concatenate([[False], piece[mine[1:]] != piece[mine[:-1]]])
        order, place = _by_count(counts)
        codes = np.zeros(len(mine) + int(cut.sum()), np.uint32)
        codes[np.arange(len(mine)) + np.cumsum(cut)] = place[number] + 1
        first = mine[first[order]]
        yield name, _texts(data, starts[first], ends[first]), counts[order], codes


def _one(*values) -> pa.RecordBatch:
    names = ["block", "lang", "words", "counts", "codes"]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v]) for v in values], names)


def word_blocks(docs: DataFrame) -> DataFrame:
    """The blocks of lang, text."""

    def build(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def blocks(held):
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            text, lang = (c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() for c in (table["text"], table["lang"]))
            for name, words, counts, codes in _blocks_of(text, lang):
                whole = pa.array([0, len(words)], pa.int32())
                yield _one(number, name, pa.ListArray.from_arrays(whole, words), pa.ListArray.from_arrays(whole, pa.array(counts.astype(np.int64))), _packed(codes))
                number += 1

        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += utf8(batch.column("text"))[1][-1]
            if size >= BLOCK_BYTES:
                yield from blocks(held)
                held, size = [], 0
        if held:
            yield from blocks(held)

    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(build, _BLOCK)


def _pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of adjacent codes other than 0, as left << 32 | right; the places of pairs, each place's pair."""
    left, right = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    places = np.flatnonzero((left > 0) & (right > 0))
    keys, number = np.unique((left[places] << np.uint64(32)) | right[places], return_inverse=True)
    return keys, places, number


def _bit(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The place of a pair of names in a filter."""
    return mix(mix(a.astype(np.uint64)) + b.astype(np.uint64)) % np.uint64(bits)


def _filter(node: DataFrame) -> Broadcast:
    """BITS bits as 64-bit words: those of the pairs a, b of node are set."""
    bits = BITS

    def words(batches):
        for batch in batches:
            if len(batch):
                places = np.unique(_bit(batch.column("a").to_numpy(), batch.column("b").to_numpy(), bits))
                at, first = np.unique(places >> np.uint64(6), return_index=True)
                set_ = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(set_.view(np.int64))], ["at", "bits"])

    rows = node.select("a", "b").mapInArrow(words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return node.sparkSession.sparkContext.broadcast(out)


def block_pairs(blocks: DataFrame, known: Broadcast | None = None) -> DataFrame:
    """block, k (the pair's number in its block), a, b (names), n: a block's pairs, each once; with a filter, those it knows and
    that stand beside another that it knows: others are part of nothing longer."""

    def count(batches):
        for batch in batches:
            for i in range(len(batch)):
                # code 1 is the first name's
                names = np.asarray(batch.column("names")[i].values, np.int64)
                keys, places, number = _pairs(_unpacked(batch.column("codes")[i].as_py()))
                k, n = np.arange(len(keys)), np.bincount(number, minlength=len(keys))
                a, b = names[(keys >> np.uint64(32)).astype(np.int64) - 1], names[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1]
                if known is not None:
                    bit = _bit(a, b, 64 * len(known.value))
                    near = (known.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                    at = near[number]
                    beside = np.flatnonzero(at[1:] & at[:-1] & (np.diff(places) == 1))
                    near = np.zeros(len(keys), bool)
                    near[number[beside]] = near[number[beside + 1]] = True
                    k, a, b, n = k[near], a[near], b[near], n[near]
                for at in range(0, len(k), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    block = batch.column("block").take(pa.array(np.full(len(k[part]), i)))
                    yield pa.RecordBatch.from_arrays([block, *[pa.array(x[part]) for x in (k, a, b, n)]], ["block", "k", "a", "b", "n"])

    return blocks.mapInArrow(count, "block long, k long, a long, b long, n long")


_NAMED = "block long, names array<long>, codes binary"


def _renamed(blocks: DataFrame, found: DataFrame, pairs: bool) -> DataFrame:
    """Blocks in which the named entries (found: block, k, id) have their names' codes and all others 0."""
    # both lists are of the same rows in the same order
    names = found.groupBy("block").agg(F.collect_list("k").alias("k"), F.collect_list("id").alias("id"))

    def rename(batches):
        for batch in batches:
            for i in range(len(batch)):
                at, ids = (np.asarray(batch.column(c)[i].values, np.int64) for c in ("k", "id"))
                codes = _unpacked(batch.column("codes")[i].as_py())
                if pairs:
                    _, places, number = _pairs(codes)
                else:
                    places = np.flatnonzero(codes)
                    number = codes[places].astype(np.int64) - 1
                counts = np.bincount(number)
                order, _ = _by_count(counts[at])
                own = np.zeros(len(counts), np.uint32)
                own[at[order]] = np.arange(1, len(at) + 1)
                # a pair stands at the place of its left half
                new = np.zeros(len(codes), np.uint32)
                new[places] = own[number]
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids[order])), pa.array([_packed(new)])], ["block", "names", "codes"])

    return blocks.select("block", "codes").join(names, "block").select("block", "codes", "k", "id").mapInArrow(rename, _NAMED)


def _with_ids(df: DataFrame) -> DataFrame:
    """df with a number from 1 that no other row has."""
    return df.withColumn("id", F.monotonically_increasing_id() + 1)


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """For each length from 1: id, lang, f, phrase, last (its last word), a, b (its parents' ids), firsts and lasts (frequencies
    of its first and last 1, 2, ... words, itself included); and lang, n, the words of each language."""
    small_batches(docs.sparkSession)
    drop: list[str] = []
    raw = written(word_blocks(docs), "words", drop, **_ROW_GROUPS)
    words = raw.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("f"))
    words = written(words, "vocabulary")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    node = written(_with_ids(words.where(F.col("f") >= least)), "names")
    frequency = F.array("f")
    nodes = [node.select("id", "lang", "f", "phrase", F.col("phrase").alias("last"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), frequency.alias("firsts"), frequency.alias("lasts"))]
    found = raw.select("block", "lang", F.posexplode("words").alias("k", "phrase")).join(node.select("lang", "phrase", "id"), ["lang", "phrase"])
    blocks = _renamed(raw, found.select("block", F.col("k").cast("long").alias("k"), "id"), pairs=False)
    while True:
        before, drop_next = drop, []
        blocks = written(blocks, "blocks", drop_next, **_ROW_GROUPS)
        forget(docs.sparkSession, before)
        drop = drop_next
        # names belong to a language, so a pair of names does
        counted = block_pairs(blocks).groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        node = written(_with_ids(counted), "names")
        up = nodes[-1]
        left = up.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("_phrase"), F.col("firsts").alias("_firsts"))
        right = up.select(F.col("id").alias("b"), "last", F.col("lasts").alias("_lasts"))
        phrase = F.concat("_phrase", F.lit(" "), "last").alias("phrase")
        grown = node.join(left, "a").join(right, "b")
        nodes.append(written(grown.select("id", "lang", "f", phrase, "last", "a", "b", F.concat("_firsts", F.array("f")).alias("firsts"), F.concat("_lasts", F.array("f")).alias("lasts")), "phrases"))
        if len(nodes) == longest:
            forget(docs.sparkSession, drop)
            return nodes, totals
        found = block_pairs(blocks, _filter(node)).drop("n").join(node.select("a", "b", "id"), ["a", "b"])
        blocks = _renamed(blocks, found.select("block", "k", "id"), pairs=True)


def _cut(length: int) -> Column:
    """The lowest score of a phrase's cuts, ties to the first: struct<score,k,l,r>."""
    exact = lambda c: c.cast("decimal(15,0)")
    cuts = []
    for k in range(1, length):
        left, right = F.col("firsts")[k - 1], F.col("lasts")[length - k - 1]
        above = exact(F.col("f")) * exact(F.col("f")) * F.lit(1_000_000).cast("decimal(7,0)")
        score = F.call_function("div", above, exact(left) * exact(right))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def candidates(nodes: list[DataFrame], share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of phrases of two words and more that no longer phrase stands for."""
    out = None
    for length, node in enumerate(nodes[1:], 2):
        rows = node.select("id", "lang", "phrase", F.col("f").alias("a"), _cut(length).alias("cut"))
        if length < len(nodes):
            # a longer phrase is in one that is longer by a word, which is at least as frequent
            above = nodes[length].select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("most")).groupBy("id").agg(F.max("most").alias("most"))
            rows = rows.join(above, "id", "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
        rows = rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        out = rows if out is None else out.unionByName(rows)
    return out


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` rows of each lang by score, a (both falling) and phrase, with their rank from 1."""
    spark = rows.sparkSession
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    # a language is a run of each partition that it touches
    part = F.shiftright("_at", 33).alias("_part")
    runs = placed.groupBy("lang", part).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("lang", "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    rows = placed.withColumn("_part", F.shiftright("_at", 33)).join(runs, ["lang", "_part"])
    return rows.withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first") + 1).where(F.col("rank") <= top).drop("_part", "_at", "_first", "_before")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs' lang and text."""
    nodes, totals = levels(docs, longest, least)
    return best(candidates(nodes, share), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed WHERE len(w) > 0),
grams AS (
  SELECT lang, w[i] AS w1, CASE WHEN i + 1 <= len(w) THEN w[i + 1] END AS w2, CASE WHEN i + 2 <= len(w) THEN w[i + 2] END AS w3 FROM placed),
total AS (SELECT lang, count(*) AS n FROM grams GROUP BY lang),
one AS (SELECT lang, w1, count(*) AS f FROM grams GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  WHERE NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND h.w1 = t.w1 AND h.w2 = t.w2 AND 100 * h.f >= 50 * t.f)
    AND NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND h.w2 = t.w1 AND h.w3 = t.w2 AND 100 * h.f >= 50 * t.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (
  SELECT *, CAST((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM lowest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
