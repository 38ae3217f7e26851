"""Retrieval from end to end: rankings with their zero padding, metrics, outcomes, effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import metrics, scoring, search
from tallyloom.plans import inputs


def judged_rankings(spark: SparkSession, sf_dir: str, k: int = inputs.DEPTH) -> DataFrame:
    """Zero-padded rankings of judged queries, so that recall counts documents that share no term with the query."""

    def make() -> DataFrame:
        judged = inputs.qrels(spark, sf_dir).select("query").distinct()
        own = inputs.ranked(spark, sf_dir).join(scoring.small(judged, 1_000_000), "query", "left_semi")
        configs = spark.createDataFrame([(c,) for c in _configs()], "config string")
        return search.zero_padded(own, judged.crossJoin(F.broadcast(configs)), inputs.items(spark, sf_dir), k)

    return inputs.held(spark, sf_dir, "judged", make)


def _configs():
    from tallyloom.functions.numeric import CONFIGS

    return CONFIGS


def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.held(spark, sf_dir, "metrics", lambda: metrics.judged(judged_rankings(spark, sf_dir), inputs.qrels(spark, sf_dir)))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, config, value: nDCG@10 rounded to 9 places, the table that effects are computed from."""
    return query_metrics(spark, sf_dir).select("query", "config", F.round("ndcg10", 9).alias("value"))


def dense_rankings(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    """Every vector as a query, itself excluded."""
    v = inputs.vectors(spark, sf_dir)
    return inputs.held(spark, sf_dir, "dense", lambda: search.dense_top_k(v.select(F.col("item").alias("query"), "vector"), v.select("item", "vector"), k))
