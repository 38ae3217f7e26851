"""Collection statistics and label-free diagnostics of a sparse matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numeric import smoothed_idf
from tallyloom.operators.sampling import numbered


def feature_stats(features: DataFrame) -> DataFrame:
    """feature, df, mass: partial sums in each task, so frequent features move as one row a task."""
    return features.groupBy("feature").agg(F.count("*").alias("df"), F.sum("value").alias("mass"))


def item_stats(features: DataFrame, items: DataFrame) -> DataFrame:
    """item, length, nnz of every item, also of those without features."""
    own = features.groupBy("item").agg(F.sum("value").alias("length"), F.count("*").alias("nnz"))
    return items.select("item").join(own, "item", "left").select("item", F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def collection_stats(item_rows: DataFrame) -> DataFrame:
    """One row: n_items, length_sum, nnz_sum, avg_length.  Sums are additive over shards."""
    rows = item_rows.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length_sum"), F.coalesce(F.sum("nnz"), F.lit(0)).cast("long").alias("nnz_sum"))
    return rows.withColumn("avg_length", F.when(F.col("n_items") > 0, F.col("length_sum") / F.col("n_items")).otherwise(0.0))


def collection_of(sums: DataFrame, items: Column, length: Column, nnz: Column) -> DataFrame:
    """``collection_stats`` from one row of sums."""
    rows = sums.select(items.alias("n_items"), F.coalesce(length, F.lit(0.0)).alias("length_sum"), F.coalesce(nnz, F.lit(0)).cast("long").alias("nnz_sum"))
    return rows.withColumn("avg_length", F.when(F.col("n_items") > 0, F.col("length_sum") / F.col("n_items")).otherwise(0.0))


def with_idf(feature_rows: DataFrame, collection: DataFrame) -> DataFrame:
    return feature_rows.crossJoin(F.broadcast(collection.select("n_items"))).select("feature", "df", "mass", smoothed_idf(F.col("n_items"), F.col("df")).alias("idf"))


def gini(values: DataFrame, column: str, dead: int = 0) -> DataFrame:
    """2 * sum(i * x_i) / (n * sum(x)) - (n + 1) / n over ascending x and ``dead`` zeros before them; 0 if all are 0.

    Values are counted first, so the running rank goes over distinct values; the sum of ranks of c equal values after b others is c * b + c * (c + 1) / 2.
    """
    rows = values.groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").cast("double").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + dead
    rows = rows.select("x", "c", (F.col("x") * (F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)).alias("ix"))
    n = F.coalesce(F.sum("c"), F.lit(0.0)) + dead
    total = F.sum(F.col("x") * F.col("c"))
    return rows.agg(F.when(total > 0, 2 * F.sum("ix") / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"))


def zipf(feature_rows: DataFrame) -> DataFrame:
    """frequency_slope and r2: minus the least-squares slope of ln(df) on ln(rank) over live features.

    Features of equal df are counted first; ranks of c equal ones follow b others, so only distinct dfs pass one window.  The sums of ln(rank) over a run
    of ranks are taken by exploding the run, in parallel.
    """
    live = feature_rows.where("df > 0").groupBy("df").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy(F.col("df").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = live.withColumn("b", before).select("df", F.explode(F.sequence(F.col("b") + 1, F.col("b") + F.col("c"))).alias("r"))
    ranks = ranks.select(F.log(F.col("df").cast("double")).alias("y"), F.log(F.col("r").cast("double")).alias("x"))
    return ranks.agg((-F.regr_slope("y", "x")).alias("frequency_slope"), F.when(F.var_pop("y") > 0, F.regr_r2("y", "x")).alias("r2"))


def head_shares(feature_rows: DataFrame, vocabulary: int) -> DataFrame:
    """Shares of df and mass of the ceil(1 %) most frequent features, ties by feature, at least one."""
    k = max(1, -(-vocabulary // 100))
    # a limit is taken in each task first
    head = feature_rows.orderBy(F.col("df").desc(), F.col("feature").asc()).limit(k).agg(F.sum("df").alias("hd"), F.sum("mass").alias("hm"))
    every = feature_rows.agg(F.sum("df").alias("d"), F.sum("mass").alias("m"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0).cast("double")
    return head.crossJoin(every).select(share("hd", "d").alias("head_frequency_mass"), share("hm", "m").alias("frequent_activation_share"))


def activity(feature_rows: DataFrame, collection: DataFrame, vocabulary: int) -> DataFrame:
    """active_fraction, dead_feature_fraction, live_features of a vocabulary of so many features."""
    live = feature_rows.agg(F.count_if(F.col("df") > 0).alias("live_features"))
    n = F.col("n_items") * vocabulary
    return live.crossJoin(collection).select(
        F.when(n > 0, F.col("nnz_sum") / n).otherwise(0.0).alias("active_fraction"), (1 - F.col("live_features") / F.lit(float(max(vocabulary, 1)))).alias("dead_feature_fraction"), "live_features"
    )


def index_diagnostics(features: DataFrame, items: DataFrame) -> DataFrame:
    """Variation of values and lengths: value_cv, peak_ratio, top_share, length_cv, length_log_sd, nnz_cv (population deviations)."""
    per = features.groupBy("item").agg(F.sum("value").alias("length"), F.count("*").alias("nnz"), F.max("value").alias("peak"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    per = items.select("item").join(per, "item", "left").select("item", F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce("nnz", F.lit(0)).alias("nnz"), "peak", "mean", "sd")
    cv = lambda c: F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c)).otherwise(0.0)
    return per.agg(
        F.avg(F.col("sd") / F.col("mean")).alias("value_cv"), F.avg(F.col("peak") / F.col("mean")).alias("peak_ratio"), F.avg(F.col("peak") / F.col("length")).alias("top_share"),
        cv("length").alias("length_cv"), F.stddev_pop(F.when(F.col("length") > 0, F.log("length"))).alias("length_log_sd"), cv("nnz").alias("nnz_cv"),
    )


def shuffled_df(feature_rows: DataFrame, seed: str = "0") -> DataFrame:
    """Control: dfs dealt to features anew.  Two orders of the same features, one by feature and one by hash, are joined by position."""
    features = numbered(feature_rows.select("feature"), F.col("feature").asc())
    dfs = numbered(feature_rows.select("df", F.col("feature").alias("_f")), F.sha2(F.concat(F.lit(seed + ":"), F.col("_f")), 256).asc(), F.col("_f").asc()).select("position", "df")
    return features.join(dfs, "position").select("feature", "df")


def uniform_df(feature_rows: DataFrame) -> DataFrame:
    """Control: every live feature has the rounded (half to even) mean df of live ones; dead ones keep 0."""
    mean = feature_rows.where("df > 0").agg(F.bround(F.avg("df"), 0).cast("long").alias("_mean"))
    return feature_rows.crossJoin(F.broadcast(mean)).select("feature", F.when(F.col("df") > 0, F.col("_mean")).otherwise(F.lit(0)).cast("long").alias("df"))
