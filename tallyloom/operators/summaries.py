"""Tables about results: filters and their reasons, pairs of grid cells, common members, summaries, status counts, transfer of a frozen model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.effects import fit_metrics
from tallyloom.operators.statistics import frozen_predict


def listed(rows: DataFrame, key: str, include: list | None = None, exclude: list | None = None) -> DataFrame:
    """Rows whose key is in ``include`` (all, if that is None) and not in ``exclude``; a null key is in no list."""
    if include is not None:
        rows = rows.where(F.coalesce(F.col(key).isin(include), F.lit(False)))
    return rows.where(~F.coalesce(F.col(key).isin(exclude), F.lit(False))) if exclude else rows


def eligible(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``excluded_by``: the name of the first rule that doesn't hold (null counts as not holding), null for eligible rows."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        reason = F.when(~F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("excluded_by", reason)


def paired(rows: DataFrame, keys: list[str], axis: str, a: str, b: str, value: str) -> DataFrame:
    """Cells that differ in ``axis`` alone, a against b: keys, value_a, value_b, difference; cells without a partner are left out.  One aggregation, no join."""
    of = lambda x: F.max(F.when(F.col(axis) == x, F.col(value)))
    out = rows.where(F.col(axis).isin(a, b)).groupBy(*keys).agg(of(a).alias("value_a"), of(b).alias("value_b"))
    return out.where("value_a is not null and value_b is not null").withColumn("difference", F.col("value_b") - F.col("value_a"))


def common(rows: DataFrame, member: str, group: str) -> DataFrame:
    """Members that every group has: their groups are counted against the number of all groups, without a join of groups."""
    n = rows.agg(F.count_distinct(group)).first()[0]
    return rows.groupBy(member).agg(F.count_distinct(group).alias("_n")).where(F.col("_n") == n).select(member)


def summary(rows: DataFrame, value: str, by: list[str], percentiles: tuple[float, ...] = (0.05, 0.95)) -> DataFrame:
    """n, mean, median, least, greatest and interpolated percentiles of each group; null values are left out."""
    at = lambda p: F.percentile(F.col(value).cast("double"), F.lit(p))
    ends = [at(p).alias(f"p{round(100 * p)}") for p in percentiles]
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), at(0.5).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"), *ends)


def status_counts(results: DataFrame, planned: DataFrame, key: str, by: list[str], status: str = "status") -> DataFrame:
    """Planned cells by group and status; those without a result are missing, and results that weren't planned aren't counted."""
    got = results.select(key, F.col(status).alias("_status"))
    both = planned.select(key, *by).join(got, key, "left")
    return both.groupBy(*by, F.coalesce("_status", F.lit("missing")).alias("status")).agg(F.count("*").alias("cells"))


def weighted_mean(rows: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Null where all weights are 0."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted_mean"))


def row_names(rows: DataFrame, name: str) -> DataFrame:
    """Parts of row names like ``task__c4096__b512__sink0``: task, context, budget, sink; null where a name hasn't that form."""
    pattern = r"^(.+)__c(\d+)__b(\d+)__sink([01])$"
    fits = F.col(name).rlike(pattern)
    part = lambda i: F.when(fits, F.regexp_extract(name, pattern, i))
    return rows.withColumns({"task": part(1), "context": part(2).cast("int"), "budget": part(3).cast("int"), "sink": part(4) == "1"})


def incremental_r2(rows: DataFrame, estimate: str, baseline: str, target: str) -> DataFrame:
    """r2 of an estimate, of a baseline, and what the former adds; null without variation of the target."""
    r2 = lambda e: F.when(F.var_pop(target) > 0, 1 - F.avg((F.col(e) - F.col(target)) ** 2) / F.var_pop(target))
    return rows.agg(F.count("*").alias("n"), r2(estimate).alias("r2"), r2(baseline).alias("baseline_r2")).withColumn("gain", F.col("r2") - F.col("baseline_r2"))


def transfer(rows: DataFrame, model: dict, features: list[str], target: str) -> DataFrame:
    """A frozen model on rows it wasn't fitted on: n and the metrics of its estimates.  Rows with a missing feature or target aren't rows to judge by."""
    some = frozen_predict(rows.dropna(subset=[*features, target]), model, features).select("estimate", F.col(target).alias("target"))
    return some.agg(F.count("*").alias("n")).crossJoin(fit_metrics(some))


def feature_metadata(features: DataFrame, kind: str, size: int, codes: int = 0) -> DataFrame:
    """Of feature ids what they stand for: coordinate and sign (identity, random, pca), code and group (pq, rq), or a component."""
    f = F.col("feature")
    checked = F.when((f < 0) | (f >= size), F.raise_error(F.lit("a feature outside the vocabulary")).cast("long")).otherwise(f)
    out = features.withColumn("feature", checked)
    if kind in ("identity", "random", "pca"):
        return out.select("feature", (f % (size // 2)).alias("coordinate"), F.when(f < size // 2, "positive").otherwise("negative").alias("sign"))
    if kind in ("pq", "rq"):
        return out.select("feature", (f % codes).alias("code"), F.floor(f / codes).alias("group"), F.lit("subspace" if kind == "pq" else "residual_stage").alias("group_kind"))
    return out.select("feature", f.alias("component"))


def needle_rates(rates: DataFrame, needles: DataFrame) -> DataFrame:
    """Of selection rates (unit, page, rate) and each unit's page of interest (unit, needle): the page's rank (ties to the earlier page) and rate, the first and
    the last page's rate, and the median."""
    both = rates.join(needles, "unit")
    own = both.where(F.col("page") == F.col("needle")).select("unit", F.col("rate").alias("needle_rate"))
    both = both.join(own, "unit")
    ahead = (F.col("rate") > F.col("needle_rate")) | ((F.col("rate") == F.col("needle_rate")) & (F.col("page") < F.col("needle")))
    return both.groupBy("unit").agg(
        F.count("*").alias("pages"), F.first("needle").alias("needle_page"), (F.count_if(ahead) + 1).alias("needle_rank"), F.first("needle_rate").alias("needle_rate"),
        F.min_by("rate", "page").alias("sink_rate"), F.max_by("rate", "page").alias("last_page_rate"), F.percentile("rate", F.lit(0.5)).alias("median_rate"),
    )


def attention_output(logits: DataFrame, values: DataFrame) -> DataFrame:
    """Attention over the selected positions alone: softmax of (unit, position, logit) times (position, d, value), summed to unit, d, value."""
    top = logits.groupBy("unit").agg(F.max("logit").alias("_top"))
    raised = logits.join(top, "unit").withColumn("_e", F.exp(F.col("logit") - F.col("_top")))
    total = raised.groupBy("unit").agg(F.sum("_e").alias("_all"))
    weights = raised.join(total, "unit").select("unit", "position", (F.col("_e") / F.col("_all")).alias("_w"))
    return weights.join(values, "position").groupBy("unit", "d").agg(F.sum(F.col("_w") * F.col("value")).alias("value"))
