"""Effects over outcome tables: paired differences, factorial effects, Shapley values, Holm's adjustment, decision rules, grids."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numeric import CONFIGS

SWITCHES = ("idf", "saturation", "length")


def wide(outcomes: DataFrame, by=("query",), value: str = "value") -> DataFrame:
    """One row per key with a column for each setting."""
    return outcomes.groupBy(*by).pivot("config", list(CONFIGS)).agg(F.first(value))


def paired_effect(table: DataFrame) -> DataFrame:
    """Of a wide table: mean difference of all on and all off, deviation (population) over the eight means, and their ratio, null where there is no spread."""
    means = table.agg(*[F.avg(c).alias(c) for c in CONFIGS])
    values = F.array(*[F.col(c) for c in CONFIGS])
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / len(CONFIGS)
    spread = F.sqrt(F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / len(CONFIGS))
    out = means.select((F.col("111") - F.col("000")).alias("delta"), spread.alias("spread"))
    return out.withColumn("margin", F.when(F.col("spread") > 1e-12, F.col("delta") / F.col("spread")))


def main_effects(table: DataFrame) -> list[Column]:
    """For each switch the mean of its four settings on minus that of its four off."""
    mean = lambda bit, i: sum((F.col(c) for c in CONFIGS if c[i] == bit), F.lit(0.0)) / 4
    return [(mean("1", i) - mean("0", i)).alias(f"{s}_effect") for i, s in enumerate(SWITCHES)]


def shapley() -> list[Column]:
    """Each switch's Shapley value on the lattice of settings: weighted differences over the subsets of the others."""
    out = []
    for i, s in enumerate(SWITCHES):
        others = [j for j in range(3) if j != i]
        total = F.lit(0.0)
        for size in range(3):
            for held in combinations(others, size):
                key = lambda on: "".join("1" if j in on else "0" for j in range(3))
                total = total + F.lit(factorial(size) * factorial(2 - size) / 6) * (F.col(key({*held, i})) - F.col(key(set(held))))
        out.append(total.alias(f"{s}_value"))
    return out


def weighted_effect(table: DataFrame, weight: str = "weight") -> DataFrame:
    """As ``paired_effect``, of means in which each key counts by its (positive) weight."""
    total = F.sum(weight)
    means = table.agg(*[(F.sum(F.col(c) * F.col(weight)) / total).alias(c) for c in CONFIGS])
    return paired_effect(means)


def responsive_on_average(table: DataFrame) -> DataFrame:
    """How many switches change the mean over all keys in some pair of settings, exactly; values are summed as decimals, so that order changes nothing."""
    means = table.agg(*[F.sum(F.col(c).cast("decimal(28,12)")).alias(c) for c in CONFIGS])
    moved = [F.greatest(*[(F.col(c) != F.col(c[:i] + "1" + c[i + 1 :])).cast("int") for c in CONFIGS if c[i] == "0"]) for i in range(3)]
    return means.select(sum(moved, F.lit(0)).alias("responsive_switches"))


def responsive(table: DataFrame, by: str = "query", tolerance: float = 1e-12) -> DataFrame:
    """How many switches change some key's value in some pair of settings."""
    moved = []
    for i in range(3):
        pairs = [(c, c[:i] + "1" + c[i + 1 :]) for c in CONFIGS if c[i] == "0"]
        moved.append(F.bool_or(sum(((F.abs(F.col(a) - F.col(b)) > tolerance).cast("int") for a, b in pairs), F.lit(0)) > 0).cast("int"))
    return table.agg(sum(moved, F.lit(0)).alias("responsive_switches"))


def holm(tests: DataFrame, p: str = "p", key: str = "test", family: tuple[str, ...] = ()) -> DataFrame:
    """Adjusted p: the running maximum of p * (m - i + 1) in order of p (ties by key), at most 1."""
    order = Window.partitionBy(*[F.col(c) for c in family] or [F.lit(0)]).orderBy(F.col(p).asc(), F.col(key).asc())
    every = Window.partitionBy(*[F.col(c) for c in family] or [F.lit(0)])
    step = tests.withColumn("_s", F.col(p) * (F.count("*").over(every) - F.row_number().over(order) + 1))
    return step.withColumn("p_adjusted", F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def decision(rows: DataFrame, estimate: str = "estimate", off: str = "off", on: str = "on") -> DataFrame:
    """Always, never, by the sign of the estimate, the better one of each row; headroom: the rule's share of what the better one gains over the better constant."""
    out = rows.agg(F.avg(on).alias("always"), F.avg(off).alias("never"), F.avg(F.when(F.col(estimate) > 0, F.col(on)).otherwise(F.col(off))).alias("rule"), F.avg(F.greatest(on, off)).alias("oracle"))
    constant = F.greatest("always", "never")
    return out.withColumn("headroom", F.when(F.col("oracle") - constant > 1e-12, (F.col("rule") - constant) / (F.col("oracle") - constant)))


def sign_accuracy(rows: DataFrame, estimate: str = "estimate", target: str = "target") -> DataFrame:
    """Over targets other than 0: share of right signs, and that of the better constant sign."""
    some = rows.where(F.col(target) != 0)
    return some.agg(F.avg((F.signum(estimate) == F.signum(target)).cast("double")).alias("sign_accuracy"), F.greatest(F.avg((F.col(target) > 0).cast("double")), F.avg((F.col(target) < 0).cast("double"))).alias("constant_accuracy"))


def fit_metrics(rows: DataFrame, estimate: str = "estimate", target: str = "target") -> DataFrame:
    """mae, rmse, r2 and AUC of the target's sign by rank sums with mean ranks for ties."""
    w = Window.orderBy("e")
    groups = rows.select(F.col(estimate).cast("double").alias("e"), (F.col(target) > 0).cast("long").alias("pos")).groupBy("e").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = groups.select("n", "pos", (before + (F.col("n") + 1) / 2).alias("rank"))
    pos, n = F.sum("pos"), F.sum("n")
    auc = ranks.agg(F.when((pos > 0) & (pos < n), (F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("auc"))
    err = F.col(estimate) - F.col(target)
    plain = rows.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.when(F.var_pop(target) > 0, 1 - F.avg(err * err) / F.var_pop(target)).alias("r2"))
    return plain.crossJoin(auc)


def precision_weights(rows: DataFrame, variance: str = "variance") -> DataFrame:
    """1 / variance with the variance (null is 0) at least a twentieth of the median of the positive ones, at most 20 times the median weight, mean 1; all 1
    without a positive variance."""
    own = F.coalesce(F.col(variance).cast("double"), F.lit(0.0))
    floor = rows.agg((F.percentile(F.when(own > 0, own), F.lit(0.5)) / 20).alias("_floor"))
    raw = rows.crossJoin(F.broadcast(floor)).withColumn("_w", F.when(F.col("_floor").isNull(), 1.0).otherwise(1 / F.greatest(own, F.coalesce("_floor", F.lit(1.0)))))
    cap = raw.agg((F.percentile("_w", F.lit(0.5)) * 20).alias("_cap"))
    capped = raw.crossJoin(F.broadcast(cap)).withColumn("_w", F.least("_w", "_cap"))
    mean = capped.agg(F.avg("_w").alias("_mean"))
    return capped.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_mean")).drop("_w", "_floor", "_cap", "_mean")


def average_rank(rows: DataFrame, value: str, alias: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank from 1 with ties at their mean."""
    w = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
    return rows.withColumn(alias, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)], F.col(value))) - 1) / 2.0)


def correlation(x: str, y: str) -> Column:
    """Pearson's; null without variation."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(rows: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    ranked = average_rank(average_rank(rows, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(correlation("_rx", "_ry").alias("rho"))


def demeaned(rows: DataFrame, value: str, group: str) -> Column:
    """A value less its group's mean."""
    return F.col(value) - F.avg(value).over(Window.partitionBy(group))


def kendall(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Tau-a over ordered pairs of a small table (an analysis table, one row per cell of a grid; broadcast while small)."""
    from tallyloom.operators.scoring import small

    a, b = rows.select(F.col(key).alias("k1"), F.col(x).alias("x1"), F.col(y).alias("y1")), rows.select(F.col(key).alias("k2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = a.join(small(b, 100_000), F.col("k1") < F.col("k2"))
    return pairs.agg(F.avg(F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))).alias("tau"))


def wilcoxon(rows: DataFrame, value: str) -> DataFrame:
    """Signed-rank statistic over values other than 0, and its one-sided p by the normal approximation's z."""
    some = average_rank(rows.where(F.col(value) != 0).withColumn("_a", F.abs(value)), "_a", "_r")
    n = F.count("*")
    plus = F.sum(F.when(F.col(value) > 0, F.col("_r")).otherwise(0.0))
    return some.agg(n.alias("n"), plus.alias("w_plus"), ((plus - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))


def macro_average(rows: DataFrame, group: str, member: str, value: str, members: tuple[str, ...]) -> DataFrame:
    """Mean over a group's members, of groups that have exactly these."""
    want = F.array_sort(F.array(*[F.lit(m) for m in members]))
    out = rows.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("_m"), F.count("*").alias("_n"), F.avg(value).alias("macro"))
    return out.where((F.col("_n") == len(members)) & (F.col("_m") == want)).select(group, "macro")
