"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, each source's repetition rate is its target over its size, and a document is
emitted floor(rate) times plus once more if its hash-seeded uniform number is below the fraction.  The draw
depends on the document's id and the seed alone, so reruns and lost executors change nothing, and no row
needs to see another one of its source: a source with a third of all rows is no hot group.

Nulls and edges: a null text has size 0; a null source is a source of its own, ordered last; a null id draws
from the empty string; repeated rows draw alike.  A source whose texts are all empty has target 0.
A very long text is one row and counted whole; ties of sources don't occur, since each is one row.
An empty table gives an empty result.  Extra columns are left alone, whatever their names; a copy's number is
in ``mix_copy``, with underscores in front where the input has a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import free_names, unit_hash, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the per-source table (one row per source, about 100 bytes) up to which it is broadcast.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size) -> the same with ``target``: weights repeat by source order; a target stops at
    ``cap`` times its source's size and the excess goes to the others by weight.

    Resharing until none is above ends at target = min(cap * size, level * weight) for one level.  Sources in
    order of cap * size / weight reach their cap one after another, so the level is the largest of
    (total - caps before) / (weights from here on).  All sums are integers, hence exact.  The windows run over
    one row per source (some 50 bytes), never over documents, but in one task: right for up to some ten million
    sources; a column of as many values as documents is no source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select(
        "source", "source_size", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long").alias("weight")
    )
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("level", left / weight)
    return level.select("source", "source_size", "weight", F.least(F.col("source_size") * F.lit(float(cap)), F.max("level").over(every) * F.col("weight")).alias("target"))


def copies(doc_id: Column, seed: int = 0) -> Column:
    """How often a document is taken, of columns ``target`` and ``source_size``."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (F.floor(rate) + (unit_hash(f"mix:{seed}", doc_id) < rate - F.floor(rate)).cast("long")).cast("long")


def with_targets(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Joins the per-source table to ``rows`` by ``source``, null-safe; broadcast if it is small, and else left to
    a join whose skewed partitions Spark splits at run time."""
    side = per_source.select(F.col("source").alias("_mix_source"), F.col("source_size"), F.col("target"))
    if side.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies and taken = copies * size."""
    narrow = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size")), "mix")
    per_source = written(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    return (
        with_targets(narrow, per_source)
        .withColumn("copies", copies(F.col("doc_id"), seed))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, and its copy's number in ``mix_copy`` (``_mix_copy`` if that is taken)."""
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = written(targets(sizes, weights, cap), "mix-targets")
    names, number = docs.columns, free_names(docs, "mix_copy")[0]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("_id"))
    taken = with_targets(rows, per_source).withColumn("_n", copies(F.col("_id"), seed)).where("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")).select(*[F.col(f"_row.`{c}`").alias(c) for c in names], F.col("_copy").alias(number))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
l AS (SELECT *,
  (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight::DOUBLE ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, max(level) OVER () * weight) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(sha256('mix:0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""
