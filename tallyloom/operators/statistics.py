"""Resampling and regression over analysis tables, in numpy within grouped Arrow or pandas calls: one group is one task's work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numeric import CONFIGS

DRAWS, SEED = 10_000, 0
ALPHAS = (0.1, 1.0, 10.0, 100.0)


def analysis_table(table: DataFrame, rows: int = 1_000_000) -> pd.DataFrame:
    """An analysis table (a row for each cell of a grid) on the driver; larger ones are refused, not cut."""
    got = table.limit(rows + 1).toPandas()
    if len(got) > rows:
        raise ValueError(f"an analysis table of more than {rows} rows isn't one for the driver")
    return got


def bootstrap(values: np.ndarray, draws: int = DRAWS, seed: int = SEED) -> dict:
    """(queries, 8) outcomes -> difference of all on and all off, its 95 % interval, p, and the margin's interval over resampled queries."""
    rng = np.random.default_rng(seed)
    n = len(values)
    delta = values[:, -1] - values[:, 0]
    margin = lambda m: np.divide(m[:, -1] - m[:, 0], m.std(1), out=np.full(len(m), np.nan), where=m.std(1) > 1e-12)
    means = np.empty((draws, values.shape[1]))
    for lo in range(0, draws, 1000):
        hi = min(lo + 1000, draws)
        means[lo:hi] = rng.multinomial(n, np.full(n, 1 / n), hi - lo) @ values / n
    d = means[:, -1] - means[:, 0]
    m = margin(means)
    m = m[~np.isnan(m)]
    full = margin(values.mean(0)[None])[0]
    low, high = np.percentile(d, [2.5, 97.5])
    ends = np.percentile(m, [2.5, 97.5]) if len(m) else (np.nan, np.nan)
    return {
        "n": n, "delta": delta.mean(), "low": low, "high": high, "p": (1 + (np.abs(d - delta.mean()) >= abs(delta.mean())).sum()) / (draws + 1),
        "margin": full, "margin_low": ends[0], "margin_high": ends[1], "margin_variance": m.var(ddof=1) if len(m) > 1 else np.nan,
    }


def bootstrap_effect(wide: DataFrame, group: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """One row per group of a wide outcome table (its queries fit one task: some thousands); undefined values are null."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("query")
        return pd.DataFrame([{group: rows[group].iloc[0], **bootstrap(rows[list(CONFIGS)].to_numpy(float), draws, seed)}])

    schema = f"{group} string, n bigint, delta double, low double, high double, p double, margin double, margin_low double, margin_high double, margin_variance double"
    return wide.withColumn(group, F.col(group).cast("string")).groupBy(group).applyInPandas(run, schema)


def cluster_bootstrap(table: pd.DataFrame, first: str, second: str, value: str, draws: int = 1000, seed: int = SEED) -> tuple[float, float]:
    """95 % interval of a mean under resampling of both kinds of clusters (weights multiply)."""
    rng = np.random.default_rng(seed)
    a, b = pd.factorize(table[first], sort=True), pd.factorize(table[second], sort=True)
    x, out = table[value].to_numpy(float), []
    for _ in range(draws):
        w = rng.multinomial(len(a[1]), np.full(len(a[1]), 1 / len(a[1])))[a[0]] * rng.multinomial(len(b[1]), np.full(len(b[1]), 1 / len(b[1])))[b[0]]
        if w.sum():
            out.append((w * x).sum() / w.sum())
    return tuple(np.percentile(out, [2.5, 97.5])) if out else (np.nan, np.nan)


def ridge(x: np.ndarray, y: np.ndarray, alpha: float, weights: np.ndarray | None = None) -> dict:
    """Standardised features, unpenalised intercept, penalty alpha on the squared coefficients of the summed weighted loss."""
    w = np.ones(len(y)) if weights is None else weights
    mean = np.average(x, axis=0, weights=w)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    scale[scale == 0] = 1
    z = (x - mean) / scale
    center, level = np.average(z, axis=0, weights=w), np.average(y, weights=w)
    zc = (z - center) * np.sqrt(w)[:, None]
    coefficients = np.linalg.solve(zc.T @ zc + alpha * np.eye(x.shape[1]), zc.T @ ((y - level) * np.sqrt(w)))
    return {"mean": mean, "scale": scale, "coefficients": coefficients, "intercept": level - center @ coefficients, "alpha": alpha}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    return (x - model["mean"]) / model["scale"] @ model["coefficients"] + model["intercept"]


def choose_alpha(x, y, groups, weights=None, alphas=ALPHAS) -> float:
    """The penalty of the least error with one group left out at a time: the mean over groups of each one's mean absolute error.

    Groups that leave fewer than two rows to fit on are passed over; ties go to the smaller penalty; with a single group it is 1.
    """
    names = [g for g in np.unique(groups) if (groups != g).sum() >= 2]
    if len(np.unique(groups)) < 2:
        return 1.0
    errors = []
    for alpha in alphas:
        left_out = ((groups == g, ridge(x[groups != g], y[groups != g], alpha, None if weights is None else weights[groups != g])) for g in names)
        errors.append(np.mean([np.abs(predict(model, x[own]) - y[own]).mean() for own, model in left_out]) if names else np.inf)
    return alphas[int(np.argmin(errors))]


def grouped_validation(table: DataFrame, features: list[str], target: str, holdout: str, inner: str, key: str) -> DataFrame:
    """Predictions for each group held out, of a model fitted on the others with its penalty chosen inside them: (key, holdout, target, estimate, baseline).

    The analysis table (one row per cell of the experiment grid, thousands) is broadcast; each fold is one task.
    """
    every = analysis_table(table.select(key, holdout, inner, target, *features)).sort_values(key)
    held = table.sparkSession.sparkContext.broadcast(every)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        name, t = rows["fold"].iloc[0], held.value
        out = t[holdout].astype(str) == name
        train, test = t[~out], t[out]
        x, y = train[features].to_numpy(float), train[target].to_numpy(float)
        model = ridge(x, y, choose_alpha(x, y, train[inner].to_numpy()))
        return pd.DataFrame({"key": test[key].astype(str), "fold": name, "target": test[target].astype(float), "estimate": predict(model, test[features].to_numpy(float)), "baseline": y.mean(), "alpha": model["alpha"]})

    folds = table.select(F.col(holdout).cast("string").alias("fold")).distinct()
    return folds.groupBy("fold").applyInPandas(fold, "key string, fold string, target double, estimate double, baseline double, alpha double")


def frozen_predict(table: DataFrame, model: dict, features: list[str]) -> DataFrame:
    """A frozen model as a column expression."""
    total = F.lit(float(model["intercept"]))
    for name, c, m, s in zip(features, model["coefficients"], model["mean"], model["scale"], strict=True):
        total = total + float(c) * (F.col(name) - float(m)) / float(s)
    return table.withColumn("estimate", total)
