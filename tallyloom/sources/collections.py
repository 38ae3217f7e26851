"""Scans of documents, queries and judgments, with their checks, and sinks of records and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions.text import content


def documents(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    """doc_id, content.  JSON lines may name the id ``doc_id`` or ``_id``; blank lines are skipped."""
    if kind == "parquet":
        rows = spark.read.parquet(path)
    else:
        rows = spark.read.schema(schemas.DOCUMENTS + ", _id string").json(path)
    columns = rows.columns
    key = F.coalesce(*[F.col(c).cast("string") for c in ("doc_id", "_id") if c in columns])
    title = F.col("title") if "title" in columns else F.lit("")
    return rows.select(key.alias("doc_id"), content(title, F.col("text")).alias("content"))


def queries(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    rows = spark.read.parquet(path) if kind == "parquet" else spark.read.schema(schemas.QUERIES + ", _id string").json(path)
    key = F.coalesce(*[F.col(c).cast("string") for c in ("query_id", "_id") if c in rows.columns])
    return rows.select(key.alias("query_id"), "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgments from lines of three fields (query, document, grade; a header, told by its first field, is skipped) or four (with an unused second one); other
    lines are errors.  A path that ends in .jsonl has records of query-id, corpus-id and score."""
    if path.rstrip("/").endswith(".jsonl"):
        rows = spark.read.schema("`query-id` string, `corpus-id` string, score int").json(path)
        return rows.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.col("score").alias("relevance"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) != ''").select(parts.alias("p"))
    rows = rows.where(~F.element_at("p", 1).isin("query-id", "query_id"))
    doc = F.when(F.size("p") == 3, F.try_element_at("p", F.lit(2))).when(F.size("p") == 4, F.try_element_at("p", F.lit(3))).otherwise(F.raise_error(F.concat(F.lit("not a judgment: "), F.array_join("p", " "))))
    return rows.select(F.element_at("p", 1).alias("query_id"), doc.alias("doc_id"), F.element_at("p", -1).cast("int").alias("relevance"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """An external feature matrix in long form."""
    return spark.read.schema(schemas.FEATURES).parquet(path)


ADAPTERS = {"documents": documents, "queries": queries, "qrels": qrels, "features": features}


def scan(spark: SparkSession, spec: dict) -> DataFrame:
    """Dispatch on ``spec['table']``; the rest is the adapter's arguments."""
    if spec.get("table") not in ADAPTERS:
        raise ValueError(f"no adapter for {spec.get('table')!r}")
    return ADAPTERS[spec["table"]](spark, **{k: v for k, v in spec.items() if k != "table"})


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result records of a tree whose status is complete."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path).where("status = 'complete'")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("errorifexists").option("header", "true").csv(path)


def markdown(df: DataFrame, max_rows: int = 1000) -> str:
    """A small report table as Markdown; larger ones are refused, not cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a report of more than {max_rows} rows isn't one to read")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *(f"| {' | '.join(cell(v) for v in r)} |" for r in rows)])


def canonical_json(value) -> str:
    """Sorted keys, no spaces, no NaN: what is hashed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
