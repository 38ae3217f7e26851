"""Scoring document by document against the postings' joins."""

import numpy as np
from pyspark.sql import functions as F

from tallyloom import catalog
from tallyloom.operators import lexical, scoring, search, sparse, stats
from tallyloom.plans import inputs


def write(spark, folder, extra=()):
    rng = np.random.default_rng(2)
    words = ["Straße", "éclair", "alpha", *[f"w{i}" for i in range(30)]]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    texts = [text(int(n)) for n in rng.integers(3, 40, 60)] + [None, "", "..."]
    texts += [texts[5]] * 9  # ties
    passages = [*(text(6) for _ in range(7)), "w3", "w1 w2"]
    texts += [f"x {passages[0]}y {passages[3]} z", f"{passages[1]}"]
    spark.createDataFrame([*enumerate(texts), *extra], "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 72, 3)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts, passages


def by_joins(spark, d):
    docs = inputs.documents(spark, d)
    posts = sparse.counts(docs)
    rows = stats.item_stats(posts, inputs.items(spark, d))
    weighted = scoring.weighted_postings(posts, stats.feature_stats(posts), rows, stats.collection_stats(rows))
    return posts, rows, scoring.scores(inputs.query_features(spark, d), weighted)


def test_rankings_document_by_document(spark, tmp_path, monkeypatch):
    """The tops equal those of all pairs, and no pairs are kept."""
    for name, value in (("ASKED", 4), ("SCORED", 5), ("COUNTED", 20)):
        monkeypatch.setattr(lexical, name, value)
    d = str(tmp_path)
    texts, passages = write(spark, d)
    posts, rows, scores = by_joins(spark, d)
    want = {(r["query"], r["config"], r["rank"]): (r["item"], round(r["score"], 9)) for r in search.top_k(scoring.by_config(scores), 13).collect()}
    assert {(r["query"], r["config"], r["rank"]): (r["item"], round(r["score"], 9)) for r in inputs.best(spark, d, 13).collect()} == want
    half = F.col("item").cast("int") % 2 == 0
    some = {(r["query"], r["config"], r["rank"]): r["item"] for r in search.top_k(scoring.by_config(scores.where(half)), 3).collect()}
    assert {(r["query"], r["config"], r["rank"]): r["item"] for r in inputs.best(spark, d, 3, half).collect()} == some
    seen = {(r["query"], r["matched_items"], r["posting_visits"]) for r in scores.groupBy("query").agg(F.count("*").alias("matched_items"), F.sum("matched").alias("posting_visits")).collect()}
    assert {(r["query"], r["matched_items"], r["posting_visits"]) for r in catalog.QUERIES["posting_visits"](spark, d).collect()} == seen
    # statistics without postings
    assert sorted(map(tuple, inputs.feature_rows(spark, d).collect())) == sorted(map(tuple, stats.feature_stats(posts).collect()))
    assert inputs.collection(spark, d).first() == stats.collection_stats(rows).first()
    held = {"scores", "postings"}
    assert not [k for k in inputs._HELD if k[1] == d and k[2] in held]
    found = {(str(q), str(i)) for q, p in enumerate(passages) for i, t in enumerate(texts) if p in (t or "")}
    assert {(r["query"], r["item"]) for r in inputs.qrels(spark, d).collect()} == found
    inputs.release()
    monkeypatch.setattr(inputs, "PASSAGES", 2)
    assert {(r["query"], r["item"]) for r in inputs.qrels(spark, d).collect()} == found


def test_repeated_and_null_ids_are_grouped(spark, tmp_path):
    d = str(tmp_path)
    write(spark, d, extra=[(3, "alpha alpha w1"), (None, "alpha w2")])
    posts, rows, scores = by_joins(spark, d)
    assert not inputs.whole(spark, d) and inputs.asked(spark, d) is None
    assert sorted(map(tuple, inputs.feature_rows(spark, d).collect())) == sorted(map(tuple, stats.feature_stats(posts).collect()))
    assert inputs.collection(spark, d).first() == stats.collection_stats(rows).first()
    want = {(r["query"], r["config"], r["rank"]): r["item"] for r in search.top_k(scoring.by_config(scores), 13).collect()}
    assert {(r["query"], r["config"], r["rank"]): r["item"] for r in inputs.best(spark, d, 13).collect()} == want


def test_tops_are_exchanged_as_a_row_for_each_query_and_task(spark, tmp_path):
    """No row for each query, setting and item is exchanged or sorted; without matches there are no rows."""
    d = str(tmp_path)
    write(spark, d)
    plan = inputs.best(spark, d, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query" in plan and "config#" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
    rows, terms, vocabulary, known = inputs.asked(spark, d)
    assert lexical.best(rows.where("false"), terms, vocabulary, known, 5).isEmpty() and lexical.best(rows, [], vocabulary, known, 5).isEmpty()
    got = lexical.best(rows, terms, vocabulary, known, 10_000)
    assert dict(got.dtypes)["rank"] == "int" and got.groupBy("query", "config").agg((F.max("rank") == F.count("*")).alias("ok")).where("NOT ok").isEmpty()
