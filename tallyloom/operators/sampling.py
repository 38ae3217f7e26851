"""Samples and splits by hash: the same rows whatever the input's order or partitioning."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numeric import hash_key
from tallyloom.session import work_folder


def bottom_hash(rows: DataFrame, key: Column, k: int, seed: str) -> DataFrame:
    """The k rows of the least hash; each task sends k rows at most."""
    return rows.withColumn("_h", hash_key(seed, key)).orderBy("_h", key.cast("string")).limit(k).drop("_h")


def split(rows: DataFrame, key: Column, fraction: float, seed: str) -> DataFrame:
    """Adds ``part``: validation for max(1, floor(n * fraction)) rows of the least hash, train for the rest.

    The size of the validation part is exact; its largest hash is found by counts of the hashes' first four digits and a limit within the range that holds
    it, so no task sees more than a 65,536th of the rows.
    """
    marked = rows.withColumn("_h", F.concat(hash_key(f"split:{seed}", key), key.cast("string")))
    counts = sorted(map(tuple, marked.groupBy(F.substring("_h", 1, 4).alias("b")).count().where("b is not null").collect()))
    n = sum(c for _, c in counts)
    left = max(1, int(n * fraction)) if n else 0
    for at, c in counts:  # noqa: B007
        if left <= c:
            break
        left -= c
    bin_rows = marked.select("_h").where(F.substring("_h", 1, 4) == at) if counts else marked.select("_h").where("false")
    last = bin_rows.orderBy("_h").limit(left).agg(F.max("_h").alias("_last"))
    return marked.crossJoin(F.broadcast(last)).withColumn("part", F.when(F.col("_h") <= F.col("_last"), "validation").otherwise("train")).drop("_h", "_last")


def quota(rows: DataFrame, group: str, key: Column, per_group: int, capacity: int, seed: str) -> DataFrame:
    """At most ``per_group`` rows of each group by hash, and of these ``capacity`` in all, groups in hash order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(hash_key(seed, key)))
    kept = rows.withColumn("_p", place).where(F.col("_p") <= per_group)
    return kept.withColumn("_g", hash_key(seed, F.col(group))).orderBy("_g", "_p").limit(capacity).drop("_g", "_p")


def numbered(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Adds each row's place, from 1, in an order of all rows, without a window over all: rows are sorted by ranges and written with their places in their
    range; the ranges' sizes, one row each, give what stands before."""
    path = f"{work_folder(rows.sparkSession)}/tallyloom/numbered-{uuid.uuid4().hex}"
    rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    done = rows.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_id", 33))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = done.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return done.join(F.broadcast(ranges), "_range").withColumn(name, place).drop("_id", "_range", "_before")


def systematic(rows: DataFrame, order: list[Column], step: int) -> DataFrame:
    """Every ``step``-th row in the given order, the first included."""
    return numbered(rows, *order, name="_p").where((F.col("_p") - 1) % step == 0).drop("_p")
