"""Retrieval metrics of rankings against graded judgments, and label-free comparisons of rankings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.scoring import small


def judged(ranked: DataFrame, qrels: DataFrame, by=("query", "config")) -> DataFrame:
    """nDCG@10 (linear gain, ideal from all judgments), MRR@10, recall at 100 and 1000, per judged query; 0 for queries without a positive judgment."""
    grades = qrels.select("query", "item", F.greatest(F.coalesce("grade", F.lit(0)), F.lit(0)).alias("grade"))
    # the ideal ranking has the grades in order, so counts of grades are enough, and no window goes over a query's judgments
    upto = F.sum("n").over(Window.partitionBy("query").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = F.array(*[F.lit(sum(1 / math.log2(p + 1) for p in range(1, n + 1)) + 0.0) for n in range(11)])
    discounts = lambda p: F.element_at(sums, F.least(p, F.lit(10)).cast("int") + 1)
    ideal = grades.groupBy("query", "grade").agg(F.count("*").alias("n")).withColumn("p", upto).groupBy("query").agg(
        F.sum(F.col("grade") * (discounts(F.col("p")) - discounts(F.col("p") - F.col("n")))).alias("ideal"), F.sum(F.when(F.col("grade") > 0, F.col("n")).otherwise(0)).alias("positives")
    )
    rest = [c for c in by if c != "query"]
    hits = ranked.select(*by, "item", "rank").join(small(grades.where("grade > 0")), ["query", "item"])
    sums = hits.groupBy(*by).agg(
        F.sum(F.when(F.col("rank") <= 10, F.col("grade") / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"),
        F.count_if(F.col("rank") <= 100).alias("h100"), F.count_if(F.col("rank") <= 1000).alias("h1000"),
    )
    groups = ranked.select(*by).distinct().join(ideal, "query")
    out = groups.join(sums, list(by), "left")
    share = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0).cast("double")
    return out.select(
        "query", *rest, share("dcg", "ideal").alias("ndcg10"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr10"),
        share("h100", "positives").alias("recall100"), share("h1000", "positives").alias("recall1000"),
    )


def agreement(a: DataFrame, b: DataFrame, depth: int = 10) -> DataFrame:
    """Per query 1 - |A and B| / depth of two rankings' tops."""
    queries = a.select("query").union(b.select("query")).distinct()
    both = a.where(F.col("rank") <= depth).select("query", "item").join(b.where(F.col("rank") <= depth).select("query", "item"), ["query", "item"]).groupBy("query").count()
    return queries.join(both, "query", "left").select("query", (1 - F.coalesce("count", F.lit(0)) / depth).alias("disagreement"))


#: Pairs of settings that differ in saturation alone.
SATURATION_PAIRS = (("000", "010"), ("001", "011"), ("100", "110"), ("101", "111"))


def disruption(ranked: DataFrame, pairs=SATURATION_PAIRS, depth: int = 10) -> DataFrame:
    """Mean over pairs of settings and queries of the share of the top that changes."""
    side = {k: ranked.where(F.col("rank") <= depth).select("query", "item", "config") for k in "ab"}
    mate = F.create_map(*[F.lit(x) for p in pairs for x in p])
    a = side["a"].withColumn("mate", mate[F.col("config")]).where("mate is not null")
    same = a.join(side["b"].withColumnsRenamed({"config": "mate"}), ["query", "item", "mate"]).groupBy("query", "config").count()
    groups = a.select("query", "config").distinct()
    return groups.join(same, ["query", "config"], "left").agg(F.avg(1 - F.coalesce("count", F.lit(0)) / depth).alias("disruption"))


def score_shape(ranked: DataFrame, by=("query", "config")) -> DataFrame:
    """nqc: population deviation over absolute mean of the top 100 scores (null below two or at mean 0); gap: (first - tenth) / |first|."""
    top = ranked.where(F.col("rank") <= 100).groupBy(*by).agg(
        F.count("*").alias("n"), F.stddev_pop("score").alias("sd"), F.avg("score").alias("mean"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 10, F.col("score"))).alias("s10")
    )
    return top.select(*by, F.when((F.col("n") > 1) & (F.col("mean") != 0), F.col("sd") / F.abs("mean")).alias("nqc"), F.when(F.col("s1") != 0, (F.col("s1") - F.col("s10")) / F.abs("s1")).alias("gap"))


def token_f1(pairs: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Multiset F1 of two token arrays of each row."""
    side = lambda c: pairs.select(key, F.explode(c).alias("t")).groupBy(key, "t").agg(F.count("*").alias(f"n_{c}"))
    both = side(a).join(side(b), [key, "t"]).groupBy(key).agg(F.sum(F.least(f"n_{a}", f"n_{b}")).alias("common"))
    total = F.size(a) + F.size(b)
    return pairs.join(both, key, "left").select(key, F.when(total > 0, 2 * F.coalesce("common", F.lit(0)) / total).otherwise(1.0).cast("double").alias("f1"))
