"""The given tables in the roles of a retrieval collection.

What several queries share (postings, their statistics, the lattice of scores) is persisted once for each session and folder, spilling to disk, so
documents are tokenised once; ``release`` gives it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import tokens
from tallyloom.operators import lexical, scoring, search, sparse, stats

DEPTH = 1000
#: Passages that each task holds, at most.
PASSAGES = 10_000
_HELD: dict[tuple, DataFrame] = {}
_FACTS: dict[tuple, object] = {}


def held(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _HELD:
        _HELD[key] = make().persist(StorageLevel.MEMORY_AND_DISK)
    return _HELD[key]


def release() -> None:
    for df in _HELD.values():
        df.unpersist()
    _HELD.clear()
    _FACTS.clear()


def fact(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    """As ``held``, of what the driver knows."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FACTS:
        _FACTS[key] = make()
    return _FACTS[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, tokens."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item"), tokens(F.col("text")).alias("tokens"))


def whole(spark: SparkSession, sf_dir: str) -> bool:
    """Whether each row of ``documents`` is an item of its own, so that it can be counted without meeting others; else postings are grouped by item."""
    ids = table(spark, sf_dir, "documents").groupBy("doc_id").count()
    return fact(spark, sf_dir, "whole", lambda: ids.where("count > 1 OR doc_id IS NULL").isEmpty())


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, feature (a term), value (its count)."""
    return held(spark, sf_dir, "postings", lambda: sparse.counts(documents(spark, sf_dir)))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    if whole(spark, sf_dir):
        return held(spark, sf_dir, "features", lambda: lexical.feature_stats(documents(spark, sf_dir)))
    return held(spark, sf_dir, "features", lambda: stats.feature_stats(postings(spark, sf_dir)))


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir, "items", lambda: stats.item_stats(postings(spark, sf_dir), items(spark, sf_dir)))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row.  Sums over features are those over items, where each row is an item."""
    if not whole(spark, sf_dir):
        return held(spark, sf_dir, "collection", lambda: stats.collection_stats(item_rows(spark, sf_dir)))
    sums = feature_rows(spark, sf_dir).agg(F.sum("mass").alias("length"), F.sum("df").alias("nnz"))
    return held(spark, sf_dir, "collection", lambda: stats.collection_of(items(spark, sf_dir).agg(F.count("*").alias("n_items")).crossJoin(sums), F.col("n_items"), F.col("length"), F.col("nnz")))


def query_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, feature, value: each benchmark passage's distinct terms."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("feature"))
    return rows.withColumn("value", F.lit(1.0))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.weighted_postings(postings(spark, sf_dir), feature_rows(spark, sf_dir), item_rows(spark, sf_dir), collection(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, item, eight scores, matched."""
    return held(spark, sf_dir, "scores", lambda: scoring.scores(query_features(spark, sf_dir), weighted(spark, sf_dir)))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, config, item, score, rank: the top DEPTH matches under each setting."""
    return held(spark, sf_dir, "ranked", lambda: best(spark, sf_dir, DEPTH))


def best(spark: SparkSession, sf_dir: str, k: int, of: Column | None = None) -> DataFrame:
    """The top k matches under each setting, of all items or of those for which ``of`` holds."""
    if (own := asked(spark, sf_dir)) is None:
        rows = scoring.by_config(scores(spark, sf_dir))
        return search.top_k(rows if of is None else rows.where(of), k)
    rows, *rest = own
    return lexical.best(rows if of is None else rows.where(of), *rest, k)


def asked(spark: SparkSession, sf_dir: str) -> tuple | None:
    """``lexical.asked_terms`` of all documents, the queries' terms, their vocabulary and its statistics; None where rows aren't items, or where the
    queries are too many for the driver."""
    if not whole(spark, sf_dir):
        return None

    def make():
        terms = query_features(spark, sf_dir).distinct().limit(scoring.BROADCAST_ROWS + 1).collect()
        return None if len(terms) > scoring.BROADCAST_ROWS else (terms, sorted({r["feature"] for r in terms}))

    if (own := fact(spark, sf_dir, "terms", make)) is None:
        return None
    rows = held(spark, sf_dir, "asked", lambda: lexical.asked_terms(documents(spark, sf_dir), own[1]))
    return rows, *own, fact(spark, sf_dir, "known", lambda: lexical.term_stats(rows, own[1]))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, item, grade: documents that hold a passage; 2 if labelled good and else 1.

    Up to ``PASSAGES`` passages are looked for by ``lexical.holding``.  Of more: a document that holds a passage has all its words but the outer two, and
    so its second to fourth in a row; candidates are joined by these, and then read.  The few passages of fewer than five words have no such key and are looked for in all documents.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), F.trim("text").alias("passage")).where("passage != ''")
    passages = passages.withColumn("w", F.split("passage", r"\s+"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(1))

    def make() -> DataFrame:
        few = passages.select("query", "passage").limit(PASSAGES + 1).collect()
        hits = joined() if len(few) > PASSAGES else lexical.holding(docs, [tuple(r) for r in few])
        return hits.join(good, "doc_id", "left").select("query", F.col("doc_id").cast("string").alias("item"), (1 + F.coalesce("good", F.lit(0))).alias("grade"))

    def joined() -> DataFrame:
        keyed = passages.where(F.size("w") >= 5).select("query", "passage", F.concat_ws(" ", F.slice("w", 2, 3)).alias("key"))
        words = F.split("text", r"\s+")
        runs = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("w", i, 3))))
        places = docs.withColumn("w", words).select("doc_id", "text", F.explode(F.array_distinct(runs)).alias("key"))
        hits = places.join(scoring.small(keyed, 100_000), "key").where(F.contains("text", F.col("passage"))).select("query", "doc_id")
        short = passages.where(F.size("w") < 5).select("query", "passage")
        return hits.unionByName(docs.join(scoring.small(short, 100_000), F.contains("text", F.col("passage"))).select("query", "doc_id"))

    return held(spark, sf_dir, "qrels", make)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item"), F.col("embedding").alias("vector"), "label", "vec_id")
