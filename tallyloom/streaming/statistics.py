"""Collection statistics are sums, so a stream can carry them: features of arriving items are added to what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions.text import tokens


def running_stats(documents: DataFrame) -> DataFrame:
    """A stream of (item, text) -> feature, df, mass, updated as items arrive.  An item is whole in its row, so counts within it are taken
    before the exchange, by array functions; the state holds one row per feature."""
    words = documents.select(F.array_sort(tokens(F.col("text"))).alias("t"))
    # a sorted array's runs: a term, and how often it stands in it
    counted = words.select(F.explode(F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("feature"), F.size(F.filter("t", lambda y: y == x)).alias("n")))).alias("c"))
    return counted.groupBy("c.feature").agg(F.count("*").alias("df"), F.sum("c.n").cast("double").alias("mass"))


def write(stats: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch's changed rows as Parquet under ``path``/batch=n; a reader takes each feature's row of the last batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("feature").agg(F.max_by("df", "batch").alias("df"), F.max_by("mass", "batch").alias("mass"))
