"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    A temporary folder is made, once for the session, only where the setting is missing and Spark runs in one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return spark.sparkContext.getCheckpointDir()
