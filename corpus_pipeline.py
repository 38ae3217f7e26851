"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All but
the last return the columns of ``documents``; the last adds ``mix_copy`` (``_mix_copy`` if there is such a column).  Nulls, empty, very long and repeated
rows, ties, empty tables and extra columns are handled as each operator states.  ``run`` deletes a stage's folder and the tables made for it when the next
stage's is written; only the last one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontam, mixing, neardup, quality, secrets
from tallyloom.llm.shared import delete, scratch, shared_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; those it rejects go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id."""
    return neardup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; values of owner-specific credentials, of any shape but placeholders, are replaced in their texts."""
    return secrets.redact(docs, any_shape=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, with the copy's number in mix_copy."""
    return mixing.emit(docs)


STAGES = [("quality", good), ("near_duplicates", unique), ("decontamination", uncontaminated), ("secrets", redacted), ("mix", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/tallyloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if last:
            delete(spark, last)
        last = f"{folder}/{name}"
    return docs


#: Signatures and sampled walks have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
