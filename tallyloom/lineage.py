"""Content-addressed stage outputs: a Parquet table with a manifest, reused when its fingerprint is the same."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.config import fingerprint


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    """Read by Spark, so that any store will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return json.loads("".join(r.value for r in spark.read.text(f"{folder}/_manifest").collect()))


def artifact(spark: SparkSession, folder: str, config: dict, make: Callable[[], DataFrame], parents: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """(table, fingerprint) of a stage.  A complete output of the same fingerprint is read; otherwise the stage runs, and its manifest is written last,
    so an interrupted run leaves no complete output."""
    mark = fingerprint(config, list(parents))
    at = f"{folder}/{mark[:16]}"
    found = _manifest(spark, at)
    if not found or found["status"] != "complete" or found["fingerprint"] != mark:
        df = make()
        df.write.mode("overwrite").parquet(f"{at}/data")
        note = json.dumps({"fingerprint": mark, "config": config, "parents": list(parents), "status": "complete", "schema": df.schema.simpleString(), "written": time.time()})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/_manifest")
    return spark.read.parquet(f"{at}/data"), mark
