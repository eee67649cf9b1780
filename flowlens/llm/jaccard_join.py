"""Operator 2, n-gram Jaccard join: a grouped prefix join over word shingles.

A document's set holds its distinct n-word shingles. Documents with equal sets form a class; classes with equal
prefixes and sizes form a group; only groups meet in the prefix index. Pairs pass a size, a position and a parity
filter, and are verified on whole sets, with integer arithmetic.

The prefix order puts rare shingles first. Rarity comes from a sketch of fixed size (SKETCH counters) summed over
all documents; any order gives right results, so a sketch can only cost time.

For components, not every pair in a large group of near copies is needed. STARS rounds try, in each index entry,
each class against the heaviest of the entry (an original meets more rows than its edited copies do), the heaviest of
its own size band and one by hash, and join what they link into parts. The last round tries every pair of an entry across two
parts, which is all that could still join something, so no link that matters is lost. `jaccard_links` tries every pair.

Defined results: null or empty texts, and texts without a word, have an empty set and no link, and their own doc_id
as component_id. Rows are judged one by one, so a repeated row is a copy of the other. A null doc_id never is a
component's smallest id unless it holds nothing else (then component_id is null). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._components import components
from flowlens.llm._shared import forget, read_table, scratch, sized, small_batches, written
from flowlens.llm._words import shingle_hashes, slices, word_hashes

#: Counters of the frequency sketch, in pieces of CHUNK: 8 MB at most, whatever the input.
SKETCH, CHUNK = 1 << 20, 1 << 14
#: Ids of up to so many classes (16 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rounds of stars before the round of all pairs across parts.
STARS = 1
#: Bits of a set's parity map. Two maps differ in no more bits than their sets do in shingles.
PARITY = 1024


def _sets(batch: pa.RecordBatch, n: int):
    """(row, sorted distinct shingle hashes) of each row that has a word."""
    for at, part in slices(batch.column("text")):
        words, first = word_hashes(part, fold=True)
        for i in np.flatnonzero(np.diff(first)):
            yield at + int(i), np.unique(shingle_hashes(words[first[i] : first[i + 1]], n))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64)


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """For each slot of the sketch the number of (document, shingle) rows that fall into it."""

    def count(batches):
        total = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for _, found in _sets(batch, n):
                np.add.at(total, _slots(found), 1)
        parts = total.reshape(-1, CHUNK)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition(16, "chunk").mapInArrow(add, schema)
    total = np.zeros((SKETCH // CHUNK, CHUNK), np.int64)
    for row in parts.collect():  # SKETCH / CHUNK rows
        total[row.chunk] = np.frombuffer(row.counts, np.int64)
    return total.reshape(-1)


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size, cls (digest of the set), grp (digest of prefix and size), prefix (shingles, rare ones first), and
    parity: PARITY bits, each telling whether an odd number of the set's shingles fall on it."""
    order = docs.sparkSession.sparkContext.broadcast(frequencies(docs, n))

    def sign(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            size = [0] * len(batch)
            cls, grp, prefix, parity = ([None] * len(batch) for _ in range(4))
            for i, found in _sets(batch, n):
                keep = len(found) + (-percent * len(found) // 100) + 1
                # the rarest `keep` of them in the order (count, hash)
                first = found[np.lexsort((found, order.value[_slots(found)]))[:keep]]
                size[i] = len(found)
                cls[i] = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                grp[i] = hashlib.blake2b(first.tobytes() + len(found).to_bytes(8, "little"), digest_size=16).digest()
                prefix[i] = first.view(np.int64)
                parity[i] = np.packbits(np.bincount((found >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1).view(np.int64)
            columns = [ids.cast(pa.int64()), pa.array(size, pa.int64()), pa.array(cls, pa.binary()), pa.array(grp, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "cls", "grp", "prefix", "parity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, size long, cls binary, grp binary, prefix array<bigint>, parity array<bigint>")


class _Join:
    """The written tables of one join: signatures, classes (one row for each distinct set) and index rows."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        small_batches(docs.sparkSession)
        self.docs, self.n, self.percent, self.spark = docs, n, percent, docs.sparkSession
        self.paths: list[str] = []
        signed = written(signatures(docs, n, percent), "signatures", self.paths)
        sets = signed.where("cls is not null")
        classes = sets.groupBy("cls", "grp", "size").agg(F.min("doc_id").alias("rep"), F.first("parity").alias("parity"))
        classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        groups = classes.groupBy("grp").agg(F.min("rep").alias("rep"), F.min("cid").alias("gid"), F.count("*").alias("classes"))
        self.classes = classes.join(groups.select("grp", "gid"), "grp").select("cls", "gid", "size", "rep", "cid", "parity")
        self.classes = written(self.classes, "classes")
        groups = written(groups, "groups", self.paths)
        self.signed = written(signed.select("doc_id", "size", "cls"), "sizes")
        self.few = self.classes.count()
        self.rows = self.index(sets, groups)
        forget(self.spark, self.paths)

    def index(self, sets: DataFrame, groups: DataFrame) -> DataFrame:
        """The prefix index without entries of a single class: token, cid, at (size and position), weight.

        One document of each group stands for it here. weight: how many rows a class meets in all its entries.
        """
        groups = sized(groups, groups.count(), BROADCAST_IDS)
        firsts = sets.join(groups, [sets.grp == groups.grp, sets.doc_id.eqNullSafe(groups.rep)]).select("gid", "classes", "size", "prefix")
        tokens = firsts.select("gid", "classes", "size", F.posexplode("prefix").alias("pos", "token"))
        tokens = tokens.select("token", "gid", F.expr("shiftleft(size, 32) + pos").alias("at"), F.expr("classes > 1 and pos = 0").alias("inner"))
        # most shingles are in one group only; classes of a group share its whole prefix and meet at its first token at least
        met = tokens.groupBy("token").agg(F.count("*").alias("met"), F.max("inner").alias("shared")).where("met > 1 or shared").drop("shared")
        entries = written(tokens.join(met, "token").where("met > 1 or inner").drop("inner"), "entries", self.paths)
        weights = entries.groupBy("gid").agg(F.sum("met").alias("weight"))
        rows = entries.select("token", "gid", "at").join(sized(self.classes.select("gid", "cid"), self.few, BROADCAST_IDS), "gid").join(sized(weights, self.few, BROADCAST_IDS), "gid")
        return written(rows.select("token", "cid", "at", "weight"), "rows")

    def possible(self, at_a: str, at_b: str):
        """No pair that is similar enough fails this at its first common token."""
        (size_a, pos_a), (size_b, pos_b) = ((F.shiftright(x, 32), F.col(x).bitwiseAND(0xFFFFFFFF)) for x in (at_a, at_b))
        share = 1 + F.least(size_a - pos_a - 1, size_b - pos_b - 1)
        return (100 * F.least(size_a, size_b) >= self.percent * F.greatest(size_a, size_b)) & (100 * share >= self.percent * (size_a + size_b - share))

    def parted(self, part: DataFrame) -> DataFrame:
        """The index rows of entries that hold classes of several parts, with their part."""
        rows = self.rows.join(sized(part.select(F.col("node").alias("cid"), F.col("component").alias("part")), part.count(), BROADCAST_IDS), "cid", "left").select("token", "cid", "at", "weight", F.coalesce("part", "cid").alias("part"))
        several = rows.groupBy("token").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("token")
        return rows.join(several, "token")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """pairs: cid values a < b. Those whose whole sets are similar enough."""
        done: list[str] = []
        own = lambda c: self.classes.select(F.col("cid").alias(c), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}"))
        pairs = pairs.distinct().join(own("a"), "a").join(own("b"), "b")
        # a pair with similarity t differs in (1 - t) / (1 + t) of its sizes' sum at most
        bits = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        near = (100 + self.percent) * bits <= (100 - self.percent) * (F.col("size_a") + F.col("size_b"))
        pairs = written(pairs.where(near).select("a", "b"), "pairs", done)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        need = written(ids.join(self.classes, "cid").select("cid", "cls", "rep"), "need", done)
        n = self.n

        def again(batches):
            for batch in batches:
                found = [s for _, s in _sets(batch, n)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["cls", "items"])

        few = need.count()
        reps = sized(need.select("rep").distinct(), few, BROADCAST_IDS)
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        sets = texts.select("text").mapInArrow(again, "cls binary, items array<bigint>").join(sized(need.select("cls", "cid"), few, BROADCAST_IDS), "cls").select("cid", "items")
        sets = written(sets, "sets", done).dropDuplicates(["cid"])
        a = sets.select(F.col("cid").alias("a"), F.col("items").alias("items_a"))
        b = sets.select(F.col("cid").alias("b"), F.col("items").alias("items_b"))
        both = F.size(F.array_intersect("items_a", "items_b"))
        joined = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("common"), (F.size("items_a") + F.size("items_b")).alias("sizes"))
        links = written(joined.where(100 * F.col("common") >= self.percent * (F.col("sizes") - F.col("common"))), "links")
        forget(self.spark, done)
        return links

    def stars(self, part: DataFrame, seed: int) -> DataFrame:
        """Class pairs of one entry and different parts: each class with the heaviest of the entry, with the heaviest
        of its size band in the entry and with one taken by hash. Three pairs at most for each index row.

        The three are pre-aggregated before they are shuffled and joined to the rows, so an entry of any size is split.
        """
        me = F.struct("cid", "at", "part")
        band = F.floor(F.log(F.shiftright("at", 32).cast("double")) / F.lit(max(0.05, -math.log(self.percent / 100)))).alias("band")
        rows = written(self.parted(part).select("*", band), "parted", self.paths)
        hub = F.max_by(me, F.struct("weight", -F.col("cid"))).alias("hub")
        of_token = rows.groupBy("token").agg(hub, F.min(F.struct(F.xxhash64("cid", F.lit(seed)).alias("h"), me.alias("me")))["me"].alias("any"))
        of_band = rows.groupBy("token", "band").agg(hub.alias("near"))
        rows = rows.select("token", "band", me.alias("me")).join(of_token, "token").join(of_band, ["token", "band"])
        pairs = rows.select("me", F.explode(F.array("hub", "near", "any")).alias("other")).where("me.part <> other.part").select(F.col("me.cid").alias("a"), F.col("me.at").alias("at_a"), F.col("other.cid").alias("b"), F.col("other.at").alias("at_b"))
        return pairs.where(self.possible("at_a", "at_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def across(self, part: DataFrame) -> DataFrame:
        """All class pairs of one entry and different parts."""
        rows = self.parted(part)
        per_part = rows.groupBy("token", "part").agg(F.count("*").alias("n"))
        main = per_part.groupBy("token").agg(F.max(F.struct("n", "part"))["part"].alias("main"))
        rows = written(rows.join(main, "token"), "parted", self.paths)
        x = rows.where("part <> main").select("token", F.col("cid").alias("cid_x"), F.col("at").alias("at_x"), F.col("part").alias("part_x"))
        y = rows.select("token", "main", F.col("cid").alias("cid_y"), F.col("at").alias("at_y"), F.col("part").alias("part_y"))
        pairs = x.join(y, "token").where((F.col("part_x") != F.col("part_y")) & ((F.col("part_y") == F.col("main")) | (F.col("part_x") < F.col("part_y"))) & self.possible("at_x", "at_y"))
        return pairs.select(F.least("cid_x", "cid_y").alias("a"), F.greatest("cid_x", "cid_y").alias("b"))

    def joined(self, part: DataFrame, links: DataFrame) -> DataFrame:
        """part after the links: node, component of every node that either names."""
        of = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
        more = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
        whole = components(more).withColumnRenamed("component", "whole")
        moved = part.join(whole.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
        new = whole.join(part.select("node"), "node", "left_anti").select("node", F.col("whole").alias("component"))
        return written(moved.unionByName(new), "parts")


def _check(percent: int, n: int) -> None:
    if not 1 <= percent <= 100 or n < 1:
        raise ValueError("percent is 1 to 100, n at least 1")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id; one row for each row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of n-word shingles.
    """
    _check(percent, n)
    with scratch(docs.sparkSession):
        join = _Join(docs, n, percent)
        part = join.spark.createDataFrame([], "node long, component long")
        for seed in range(STARS):
            part = join.joined(part, join.verified(join.stars(part, seed)))
        part = join.joined(part, join.verified(join.across(part)))
        classes = join.classes.join(part.withColumnRenamed("node", "cid"), "cid", "left").select("cls", "rep", F.coalesce("component", "cid").alias("component"))
        smallest = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
        classes = written(classes.join(sized(smallest, join.few, BROADCAST_IDS), "component").select("cls", F.col("rep").alias("class_id"), "component_id"), "labelled")
        out = join.signed.select("doc_id", F.col("size").alias("n_shingles"), "cls").join(classes, "cls", "left")
        own = lambda c: F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
        return written(out.select("doc_id", "n_shingles", own("class_id"), own("component_id")), "jaccard", outlive=True)


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Every link between different sets, as (doc_a, doc_b, common, sizes) of the classes' smallest doc_id."""
    _check(percent, n)
    with scratch(docs.sparkSession):
        join = _Join(docs, n, percent)
        found = join.verified(join.across(join.spark.createDataFrame([], "node long, component long")))
        rep = lambda c: join.classes.select(F.col("cid").alias(c), F.col("rep").alias(f"doc_{c}"))
        found = found.join(rep("a"), "a").join(rep("b"), "b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "common", "sizes")
        return written(found, "links", outlive=True)


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id", "class_id")


def deduplicated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By doc_id, for tables in which it is a key: of each component the document with the smallest doc_id stays.

    Rows with one doc_id stay or go together and rows without one stay; `one_of_each` judges row by row.
    """
    found = jaccard_components(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    return kept


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component exactly one row stays; rows without a word stay.

    It is the row with the smallest doc_id, one without a doc_id only if all lack it, and one of those by row id.
    Where doc_id is a key, it is the row id; otherwise the rows are written once more with numbers of their own.
    """
    sums = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if sums.rows == sums.ids and dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        gone = written(jaccard_components(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id"), "gone")
        return docs.join(sized(gone, gone.count(), BROADCAST_IDS), "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = written(docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*columns).alias("doc")), "numbered")
    found = jaccard_components(rows.select(F.col("id").alias("doc_id"), F.col("doc.text").alias("text"))).select(F.col("doc_id").alias("id"), F.col("component_id").alias("part"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    first = found.join(rows.select("id", F.col("doc.doc_id").alias("doc_id")), "id").groupBy("part").agg(F.min(order)["id"].alias("id"))
    gone = written(found.select("id").join(first.select("id"), "id", "left_anti"), "gone")
    return rows.join(sized(gone, gone.count(), BROADCAST_IDS), "id", "left_anti").select("doc.*")
