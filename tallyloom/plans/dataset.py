"""A retrieval collection of one's own: checked, stored, indexed, evaluated under all eight settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.numeric import CONFIGS, K1
from tallyloom.functions.text import tokens as tokens_of
from tallyloom.operators import effects, integrity, metrics, scoring, search, sparse, stats
from tallyloom.sources import collections as sources


def prepare(
    spark: SparkSession, documents: str, queries: str, qrels: str, out: str, *, expected_documents: int | None = None, expected_queries: int | None = None, allowed_missing: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Reads, checks and stores a collection under ``out``: unique ids, expected numbers of rows, judgments of known queries and documents (others only with a
    reason in ``allowed_missing``; they are stored for audit), one grade for a pair."""
    docs = sources.documents(spark, documents).withColumnRenamed("doc_id", "item")
    asked = sources.queries(spark, queries).withColumnRenamed("query_id", "query")
    grades = sources.qrels(spark, qrels).select(F.col("query_id").alias("query"), F.col("doc_id").alias("item"), F.col("relevance").alias("grade"))
    for name, rows, key in (("documents", docs, "item"), ("queries", asked, "query")):
        integrity.require_empty(rows.where(F.col(key).isNull()), f"{name} without an id")
        integrity.require_empty(integrity.duplicate_keys(rows, key), f"{name} of one id")
    integrity.require_count(docs, expected_documents, "documents")
    integrity.require_count(asked, expected_queries, "queries")
    integrity.require_empty(integrity.dangling(grades, asked, "query"), "judgments of unknown queries")
    missing = integrity.dangling(grades, docs, "item", allowed=allowed_missing)
    integrity.require_empty(missing.where("reason is null"), "judgments of unknown documents")
    integrity.require_empty(integrity.conflicting(grades, ["query", "item"], "grade"), "judgments that differ")
    tables = {"documents": docs, "queries": asked, "qrels": grades.distinct(), "missing": missing}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in tables}


def index(documents: DataFrame, out: str, budget: int | None = None, binary: bool = False) -> dict[str, DataFrame]:
    """Postings with all that any setting needs, and their statistics, written under ``out``; at most ``budget`` terms of each document."""
    spark = documents.sparkSession
    tokens = documents.select("item", tokens_of(F.col("content")).alias("tokens"))
    features = sparse.sparsify(sparse.counts(tokens, binary), budget)
    features.write.mode("overwrite").parquet(f"{out}/features")
    features = spark.read.parquet(f"{out}/features")
    items, terms = stats.item_stats(features, documents), stats.feature_stats(features)
    items.write.mode("overwrite").parquet(f"{out}/items")
    terms.write.mode("overwrite").parquet(f"{out}/terms")
    items, terms = spark.read.parquet(f"{out}/items"), spark.read.parquet(f"{out}/terms")
    collection = stats.collection_stats(items)
    scoring.weighted_postings(features, terms, items, collection).write.mode("overwrite").parquet(f"{out}/postings")
    return {"features": features, "items": items, "terms": terms, "collection": collection, "postings": spark.read.parquet(f"{out}/postings")}


def evaluate(indexed: dict[str, DataFrame], queries: DataFrame, qrels: DataFrame, *, k: int = 1000, k1: float = K1, configs=CONFIGS, exclude_self: bool = False) -> dict[str, DataFrame]:
    """Rankings of judged queries (zero-padded to k), metrics per query and setting, their means, and the effect of the correction."""
    spark = queries.sparkSession
    asked = queries.join(qrels.select("query").distinct(), "query", "left_semi")
    terms = asked.select("query", F.explode(F.array_distinct(tokens_of(F.col("text")))).alias("feature")).withColumn("value", F.lit(1.0))
    scored = scoring.by_config(scoring.scores(terms, indexed["postings"], k1, configs), configs)
    own = search.top_k(scored, k, exclude=F.col("query") == F.col("item") if exclude_self else None)
    groups = asked.select("query").crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in configs], "config string")))
    rankings = search.zero_padded(own, groups, indexed["items"], k, exclude_self=exclude_self).persist()
    per_query = metrics.judged(rankings, qrels)
    names = ("ndcg10", "mrr10", "recall100", "recall1000")
    out = {"rankings": rankings, "metrics": per_query, "means": per_query.groupBy("config").agg(*[F.avg(c).alias(c) for c in names], F.count("*").alias("queries"))}
    if tuple(configs) == CONFIGS:
        out["effect"] = effects.paired_effect(effects.wide(per_query.select("query", "config", F.col("ndcg10").alias("value"))))
    return out


def algebra_error(spark: SparkSession, n: int = 64, width: int = 8) -> float:
    """Control: on a cyclic binary matrix every item has one length and every feature one df, so length is inert and idf only rescales.  The largest
    deviation from that, over all postings and settings."""
    rows = spark.range(n).select(F.col("id").cast("string").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"), "id")
    features = rows.select("item", ((F.col("id") + F.col("j")) % n).cast("string").alias("feature"), F.lit(1.0).alias("value"))
    items = stats.item_stats(features, features.select("item").distinct())
    postings = scoring.weighted_postings(features, stats.feature_stats(features), items, stats.collection_stats(items))
    columns = scoring.lattice()
    parts = [F.abs(columns[c] - columns[c[:2] + "0"]) for c in CONFIGS] + [F.abs(columns[c] - columns["0" + c[1:]] * F.col("idf")) for c in CONFIGS if c[0] == "1"]
    return postings.agg(F.max(F.greatest(*parts)).alias("e")).first().e
