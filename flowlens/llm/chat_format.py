"""Operator 9, chat formatting: snapshots of a growing conversation collapse into the longest, which is rendered.

A logged conversation whose turns are the first turns of another one is a snapshot of it. Every turn gets a hash of
all turns up to it (two 64-bit folds of position, role and text), so a conversation is a snapshot exactly if its last
hash is that of an inner turn of some other. Equal conversations collapse first, to the one with the smallest
conv_id; then an anti-join removes the snapshots. Both sides have one row for each distinct hash, so a first turn
that a third of all conversations share is one row. Only what stays is rendered.

Turns are ordered by turn, then role and text; a turn that is repeated whole stays twice. Null roles and texts count
as empty, null turns come first, rows with a null conv_id are one conversation. Other columns are ignored. A
conversation's turns meet in one row, as its rendering is one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm._shared import read_table, written

#: The rendering of one turn.
TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, pos (from 1), h1 and h2 (of all turns up to this), n (the conversation's turns)."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = Window.partitionBy("conv_id")
    order = own.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    one, two = F.xxhash64(F.lit(1), "pos", "role", "text"), F.xxhash64(F.lit(2), "text", "role", "pos")
    return rows.select("conv_id", "role", "text", "pos", F.bit_xor(one).over(so_far).alias("h1"), F.bit_xor(two).over(so_far).alias("h2"), F.count("*").over(own).alias("n"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and copies (equal conversations) of those that prefix no longer one; turns: a frame of `prefixes`."""
    whole = turns.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = turns.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", "copies")


def rendered(turns: DataFrame, kept: DataFrame) -> DataFrame:
    head, tail = TURN.split("{text}")
    before, after = head.split("{role}")
    turn = F.concat(F.lit(before), "role", F.lit(after), "text", F.lit(tail))
    rows = turns.select("conv_id", F.struct("pos", turn.alias("s")).alias("t")).join(kept.withColumnRenamed("conv_id", "_kept"), F.col("conv_id").eqNullSafe(F.col("_kept")))
    parts = rows.groupBy("conv_id", "copies").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return parts.select("conv_id", F.size("t").alias("n_turns"), "copies", F.array_join(F.col("t.s"), "").alias("rendered"))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, copies, rendered of every maximal conversation."""
    turns = written(prefixes(read_table(spark, sf_dir, "conversations")), "turns")
    return rendered(turns, maximal(turns))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
), p AS (
  SELECT *, string_agg(length(role) || ',' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t
), whole AS (
  SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY n, prefix
), kept AS (
  SELECT conv_id, copies FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.prefix = w.prefix)
)
SELECT t.conv_id, cast(count(*) AS integer) AS n_turns, kept.copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY t.conv_id, kept.copies
"""
