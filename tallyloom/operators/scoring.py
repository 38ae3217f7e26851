"""The eight-setting lattice of idf, saturation and length over postings, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numeric import B, CONFIGS, K1, relative_length, smoothed_idf, transformed

#: Rows of a broadcast side, about 100 bytes each.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``rows`` rows, and as it is, for a shuffled join, if it has more."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def weighted_postings(features: DataFrame, feature_rows: DataFrame, item_rows: DataFrame, collection: DataFrame) -> DataFrame:
    """Postings with idf and relative length: what every setting needs."""
    c = F.broadcast(collection.select("n_items", "avg_length"))
    dfs = feature_rows.select("feature", "df")
    lengths = item_rows.select("item", "length")
    return features.join(dfs, "feature").join(lengths, "item").crossJoin(c).select(
        "item", "feature", "value", smoothed_idf(F.col("n_items"), F.col("df")).alias("idf"), relative_length(F.col("length"), F.col("avg_length"), B).alias("relative")
    )


def lattice(k1: float = K1, configs=CONFIGS) -> dict[str, Column]:
    return {c: transformed(F.col("value"), F.col("idf"), F.col("relative"), c, k1) for c in configs}


def scores(query_features: DataFrame, postings: DataFrame, k1: float = K1, configs=CONFIGS) -> DataFrame:
    """(query, item, one sum per setting, matched): the query side is broadcast while it is small, so postings of frequent
    features never move by feature; sums of all settings are taken in one aggregation."""
    joined = postings.join(small(query_features.select("query", "feature", F.col("value").alias("weight"))), "feature")
    sums = [F.sum(F.col("weight") * x).alias(f"s{c}") for c, x in lattice(k1, configs).items()]
    return joined.groupBy("query", "item").agg(*sums, F.count("*").alias("matched"))


def by_config(wide: DataFrame, configs=CONFIGS) -> DataFrame:
    """One row per (query, item, config, score)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("config"), F.col(f"s{c}").alias("score")) for c in configs])
    return wide.select("query", "item", F.explode(pairs).alias("p")).select("query", "item", "p.config", "p.score")


def corrected(value: Column, idf: Column, relative: Column, opportunities: Column, config: str) -> Column:
    """The scorer for selection: an item without opportunities has idf 1."""
    return transformed(value, F.when(opportunities > 0, idf).otherwise(1.0), relative, config)
