"""Sparse non-negative matrices in long form (item, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(features: DataFrame) -> DataFrame:
    """Duplicates summed, zeros dropped; negative, null or infinite values are errors."""
    value = F.col("value").cast("double")
    ok = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    checked = F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit("not a weight: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("double"))
    return features.groupBy("item", "feature").agg(F.sum(checked).alias("value")).where("value > 0")


def sparsify(features: DataFrame, budget: int | None) -> DataFrame:
    """The ``budget`` largest values of each item, ties by lowest feature; all of them without a budget.  The limit is taken before and after
    the exchange (WindowGroupLimit)."""
    if budget is None:
        return features
    w = Window.partitionBy("item").orderBy(F.col("value").desc(), F.col("feature").asc())
    return features.withColumn("feature_rank", F.row_number().over(w)).where(F.col("feature_rank") <= budget).drop("feature_rank")


def ranked_features(features: DataFrame) -> DataFrame:
    """With each value's rank in its item, so that any smaller budget is a filter of one stored table."""
    return features.withColumn("feature_rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("value").desc(), F.col("feature").asc())))


def counts(tokens: DataFrame, binary: bool = False) -> DataFrame:
    """(item, tokens: array) -> term counts, or 1 for each term."""
    rows = tokens.select("item", F.explode("tokens").alias("feature"))
    return rows.groupBy("item", "feature").agg((F.lit(1.0) if binary else F.count("*").cast("double")).alias("value"))


def in_vocabulary(features: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Those features that a vocabulary (column feature) holds."""
    return features.join(vocabulary.select("feature").distinct(), "feature", "left_semi")


def storage_cap(budgets: DataFrame) -> DataFrame:
    """(corpus, budget) -> the budget to store for each corpus: the largest, or null if any is."""
    return budgets.groupBy("corpus").agg(F.when(F.bool_or(F.col("budget").isNull()), None).otherwise(F.max("budget")).alias("cap"))


def split_rectified(dense: DataFrame, vector: Column, dimension: Column) -> DataFrame:
    """(item, vector) -> features d (positive part) and dimension + d (negative part), with absolute values."""
    rows = dense.select("item", dimension.alias("_n"), F.posexplode(vector).alias("d", "x")).where("x != 0")
    return rows.select("item", (F.col("d") + F.when(F.col("x") < 0, F.col("_n")).otherwise(0)).cast("long").alias("feature"), F.abs(F.col("x").cast("double")).alias("value"))
