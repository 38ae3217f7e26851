"""Bases that turn dense vectors into sparse non-negative features, fitted with pyspark.ml or numpy and applied as plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.sparse import split_rectified


def identity(dense: DataFrame) -> DataFrame:
    """Coordinates, positive parts first: features d and d + dimension."""
    return split_rectified(dense, F.col("vector"), F.size("vector"))


def projected(dense: DataFrame, matrix: np.ndarray, center: np.ndarray | None = None) -> DataFrame:
    """vector -> (vector - center) @ matrix, in Arrow batches; the matrix (dimension * outputs numbers) is broadcast."""
    held = dense.sparkSession.sparkContext.broadcast((np.asarray(matrix, float), None if center is None else np.asarray(center, float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c = held.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, m.shape[0])
            y = (x if c is None else x - c) @ m
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], ["item", "vector"])

    return dense.select(F.col("item").cast("string").alias("item"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "item string, vector array<double>")


def random(dense: DataFrame, dimension: int, outputs: int, seed: int = 0) -> DataFrame:
    """Gaussian projection of variance 1 / outputs, split into positive and negative parts."""
    return identity(projected(dense, np.random.default_rng(seed).normal(size=(dimension, outputs)) / np.sqrt(outputs)))


def pca(dense: DataFrame, outputs: int) -> DataFrame:
    """Centred principal components, each with the sign that makes its largest loading positive."""
    rows = dense.select("item", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    model = PCA(k=outputs, inputCol="v", outputCol="p").fit(rows)
    axes = model.pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    n = axes.shape[0]
    center = dense.select(*[F.avg(F.element_at("vector", i + 1)).alias(str(i)) for i in range(n)]).first()
    return identity(projected(dense, axes, np.array(center, float)))


def centers(dense: DataFrame, k: int, seed: int = 0, iterations: int = 20) -> np.ndarray:
    if dense.limit(k).count() < k:
        raise ValueError("fewer rows than centres")
    rows = dense.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=k, seed=seed, maxIter=iterations).fit(rows).clusterCenters())


def nearest(dense: DataFrame, table: np.ndarray, m: int) -> DataFrame:
    """(item, feature, d2, place) of each item's m nearest centres, by squared distance and then number; ``table`` is broadcast."""
    held = dense.sparkSession.sparkContext.broadcast(np.asarray(table, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, c.shape[1])
            d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)
            order = np.argsort(d, axis=1, kind="stable")[:, :m]
            n = order.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), n))), pa.array(order.ravel().astype(np.int64)), pa.array(np.take_along_axis(d, order, 1).ravel()), pa.array(np.tile(np.arange(1, n + 1), len(x)).astype(np.int64))],
                ["item", "feature", "d2", "place"],
            )

    return dense.select(F.col("item").cast("string").alias("item"), "vector").mapInArrow(run, "item string, feature bigint, d2 double, place bigint")


def kmeans(dense: DataFrame, k: int, assignments: int = 4, seed: int = 0) -> DataFrame:
    """Soft assignment to the nearest centres: softmax of -d2 over the median positive distance."""
    near = nearest(dense, centers(dense, k, seed), assignments)
    temperature = near.where("d2 > 0").agg(F.coalesce(F.percentile("d2", F.lit(0.5)), F.lit(1.0)).alias("t"))
    z = near.crossJoin(F.broadcast(temperature)).withColumn("z", -F.col("d2") / F.col("t"))
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(Window.partitionBy("item"))))
    return e.select("item", "feature", (F.col("e") / F.sum("e").over(Window.partitionBy("item"))).alias("value"))


def product_quantised(dense: DataFrame, dimension: int, groups: int, k: int, seed: int = 0) -> DataFrame:
    """One-hot nearest centre of each of ``groups`` slices; features g * k + code; every row sums to ``groups``."""
    size = dimension // groups
    parts = []
    for g in range(groups):
        part = dense.select("item", F.slice("vector", g * size + 1, size).alias("vector"))
        parts.append(nearest(part, centers(part, k, seed + g), 1).select("item", (F.col("feature") + g * k).alias("feature"), F.lit(1.0).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def residual_quantised(dense: DataFrame, stages: int, k: int, seed: int = 0) -> DataFrame:
    """One-hot nearest centre, again of what is left, ``stages`` times; every row sums to ``stages``.  Centres are fitted one stage after
    another; codes of all stages are then found in one pass."""
    tables = []
    rest = dense.select(F.col("item").cast("string").alias("item"), F.col("vector").cast("array<double>").alias("vector"))
    for s in range(stages):
        tables.append(centers(_residuals(rest, tables), k, seed + s))
    return _codes(rest, tables, k)


def _walk(x: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.zeros((len(x), len(tables)), np.int64)
    for s, c in enumerate(tables):
        codes[:, s] = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1) if len(x) else 0
        x = x - c[codes[:, s]]
    return codes, x


def _residuals(rows: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    if not tables:
        return rows
    tables = list(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, tables[0].shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_walk(x, tables)[1]), pa.list_(pa.float64()))], ["item", "vector"])

    return rows.mapInArrow(run, "item string, vector array<double>")


def _codes(rows: DataFrame, tables: list[np.ndarray], k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, tables[0].shape[1])
            codes = _walk(x, tables)[0] + np.arange(len(tables)) * k
            n = len(tables)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), n))), pa.array(codes.ravel()), pa.array(np.ones(len(x) * n))], ["item", "feature", "value"])

    return rows.mapInArrow(run, "item string, feature bigint, value double")


def autoencoder(dense: DataFrame, encoder: np.ndarray, bias: np.ndarray, center: np.ndarray, active: int) -> DataFrame:
    """Top-k sparse code of given weights: the ``active`` largest of relu((x - center) @ encoder + bias), ties by feature."""
    code = projected(dense, np.asarray(encoder), np.asarray(center))
    shift = F.array(*[F.lit(float(b)) for b in bias])
    rows = code.select("item", F.posexplode(F.zip_with("vector", shift, lambda x, b: x + b)).alias("feature", "value")).where("value > 0")
    w = Window.partitionBy("item").orderBy(F.col("value").desc(), "feature")
    return rows.withColumn("p", F.row_number().over(w)).where(F.col("p") <= active).select("item", F.col("feature").cast("long").alias("feature"), "value")


def scaled(features: DataFrame) -> DataFrame:
    """Values over their median."""
    median = features.where("value > 0").agg(F.percentile("value", F.lit(0.5)).alias("_m"))
    return features.crossJoin(F.broadcast(median)).select("item", "feature", (F.col("value") / F.col("_m")).alias("value"))


def pooled(states: DataFrame) -> DataFrame:
    """(item, vector) of several states per item -> their mean."""
    rows = states.select("item", F.posexplode("vector").alias("d", "x")).groupBy("item", "d").agg(F.avg("x").alias("x"))
    return rows.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vector"))


def summed(features: DataFrame) -> DataFrame:
    """Features of several states per item, added up."""
    return features.groupBy("item", "feature").agg(F.sum("value").alias("value"))


def reconstruction(dense: DataFrame, decoded: DataFrame, features: DataFrame, vocabulary: int) -> DataFrame:
    """mse per coordinate, dead and active fraction of a code."""
    error = dense.select(F.col("item").cast("string").alias("item"), "vector").join(decoded.withColumnRenamed("vector", "v"), "item")
    mse = error.select(F.explode(F.zip_with("vector", "v", lambda a, b: (a - b) * (a - b))).alias("e")).agg(F.avg("e").alias("mse"))
    use = features.agg(F.count_distinct("feature").alias("live"), F.count("*").alias("nnz"), F.count_distinct("item").alias("n"))
    return mse.crossJoin(use).select("mse", (1 - F.col("live") / vocabulary).alias("dead_fraction"), (F.col("nnz") / (F.col("n") * vocabulary)).alias("active_fraction"))
