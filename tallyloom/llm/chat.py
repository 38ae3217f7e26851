"""Cumulative-snapshot collapse: of logged conversations that repeat each other's beginnings, the maximal ones stay.

Each turn's hash covers its role's length, its role and its text, so different turns never look alike; with its position it gives three numbers of 40
bits, and a conversation's rolling prefix hash after p turns is the sum of the first p of them. As a sum it can be taken in blocks of ``BLOCK`` turn
numbers and their offsets, so that a conversation with a third of all rows is spread over many tasks. A conversation whose full hash is a proper prefix's
hash of any other one goes (an anti-join; the prefixes are first made distinct, map-side, so a first turn that all share is one row per task); of equal
ones the least conv_id stays.

Turns move once, to their block, which is sorted, rendered and written; all else is done with hashes alone, until the blocks of what stays are picked.
What stays is rendered in segments, one for each block of a conversation, that joined in order are the whole: a conversation has no greatest length, and
so can't be a single row.

Nulls and edges: null roles and texts render as empty and equal the empty string; a null turn number comes first; rows equal in
conversation, turn, role and text are one turn; rows of one turn number that differ are ordered by role and text (those of one block are sorted in one
task); very long texts are read whole; rows with a null conv_id are one conversation, which of equal ones stays only if it is the only one. An empty
table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import written

BLOCK = 256
LANES = ("a", "b", "c")


def blocks(conv: DataFrame) -> DataFrame:
    """conv_id, block, n (its turns), rendered, and h: the turns' hashes in order; written."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.col("turn").cast("long")
    turn = F.struct(number.isNotNull().alias("numbered"), F.coalesce(number, F.lit(0)).alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = conv.select("conv_id", F.coalesce(F.floor(number / BLOCK), F.lit(-(1 << 62))).cast("long").alias("block"), turn.alias("x"))
    rows = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_set("x")).alias("t"))
    shown = lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>\n"))
    digest = lambda x: F.unhex(F.sha2(F.concat(F.length(x["role"]).cast("string"), F.lit(":"), x["role"], x["text"]), 256))
    return written(rows.select("conv_id", "block", F.size("t").cast("long").alias("n"), F.array_join(F.transform("t", shown), "").alias("rendered"), F.transform("t", digest).alias("h")), "chat-blocks")


def rolling(parts: DataFrame) -> DataFrame:
    """Of blocks() rows: conv_id, block, position, last, and the prefix hash up to each turn in lanes a, b and c."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("conv_id")).alias("turns"))
    rows = _at_block(parts.select("conv_id", "block", "h"), counts)
    rows = rows.select("conv_id", "block", "turns", "offset", F.posexplode("h").alias("place", "h")).withColumn("position", F.col("offset") + F.col("place") + 1)
    digest = F.sha2(F.concat(F.col("position").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("h")), 256)
    rows = rows.select("conv_id", "block", "position", "turns", *[F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("long").alias(k) for i, k in enumerate(LANES)])
    inside = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.select("conv_id", "block", "position", "turns", *[F.sum(k).over(inside).alias(k) for k in LANES]), "chat-prefixes")
    ends = rows.groupBy("conv_id", "block").agg(*[F.max(k).alias(f"{k}_all") for k in LANES])
    ends = ends.select("conv_id", "block", *[F.coalesce(F.sum(f"{k}_all").over(before), F.lit(0)).alias(f"{k}_before") for k in LANES])
    rows = _at_block(rows, ends)
    return rows.select("conv_id", "block", "position", (F.col("position") == F.col("turns")).alias("last"), *[(F.col(k) + F.col(f"{k}_before")).alias(k) for k in LANES])


def _at_block(rows: DataFrame, side: DataFrame) -> DataFrame:
    side = side.withColumnRenamed("conv_id", "_conv").withColumnRenamed("block", "_block")
    return rows.join(side, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")


def maximal(rows: DataFrame) -> DataFrame:
    """Of rolling() rows: conv_id, turns and n_copies of the conversations that stay."""
    key = ["position", *LANES]
    full = rows.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = rows.where(~F.col("last")).select(*key).distinct()
    return full.join(prefixes, key, "left_anti").select("conv_id", F.col("position").cast("long").alias("turns"), "n_copies")


def collapse(conv: DataFrame) -> DataFrame:
    """conv_id, turns, n_copies, segment (from 0), n_turns in it, and rendered: the maximal conversations."""
    parts = blocks(conv)
    keep = maximal(written(rolling(parts), "chat-rolling"))
    # a segment's number needs no texts either
    named = parts.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block")).join(keep, F.col("_conv").eqNullSafe(F.col("conv_id")))
    segment = F.row_number().over(Window.partitionBy("_conv").orderBy("_block")) - 1
    named = written(named.select("_conv", "_block", "turns", "n_copies", segment.cast("long").alias("segment")), "chat-kept")
    out = parts.select("conv_id", "block", "n", "rendered").join(named, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    return out.select("conv_id", "turns", "n_copies", "segment", F.col("n").alias("n_turns"), "rendered")


def query(spark, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS turns,
  string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(turns) AS turns FROM p WHERE position = turns GROUP BY prefix),
k AS (SELECT * FROM f WHERE prefix NOT IN (SELECT prefix FROM p WHERE position < turns)),
s AS (SELECT conv_id, floor(turn / 256.0) AS block, count(*) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY position) AS rendered FROM p GROUP BY ALL)
SELECT s.conv_id, k.turns::BIGINT AS turns, k.n_copies::BIGINT AS n_copies, (row_number() OVER (PARTITION BY s.conv_id ORDER BY block NULLS FIRST) - 1)::BIGINT AS segment,
  s.n_turns::BIGINT AS n_turns, s.rendered FROM s JOIN k ON s.conv_id IS NOT DISTINCT FROM k.conv_id
"""
