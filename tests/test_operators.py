"""Operators of the retrieval library, against plain Python and numpy, and by their algebra."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyloom.functions import numeric, text
from tallyloom.functions.numeric import CONFIGS
from tallyloom.operators import bases, effects, integrity, metrics, sampling, scoring, search, selection, sparse, statistics, stats


@pytest.fixture(scope="module")
def matrix(spark):
    """Items as strings ("10" < "2"), with ties, an empty item and copies; and queries."""
    rng = np.random.default_rng(11)
    values = rng.integers(0, 4, (40, 25)).astype(float)
    values[7] = 0
    values[8] = values[9]
    rows = [(str(i), f"f{j:02}", float(v)) for (i, j), v in np.ndenumerate(values) if v]
    queries = rng.integers(0, 3, (6, 25)).astype(float)
    asked = [(str(q), f"f{j:02}", float(v)) for (q, j), v in np.ndenumerate(queries) if v] + [("0", "unseen", 1.0)]
    return values, queries, spark.createDataFrame(rows, "item string, feature string, value double"), spark.createDataFrame([(str(i),) for i in range(40)], "item string"), spark.createDataFrame(asked, "query string, feature string, value double")


def exhaustive(values, queries):
    """Scores of all pairs under each setting, in numpy."""
    n, df, length = len(values), (values > 0).sum(0), values.sum(1)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    relative = 0.25 + 0.75 * length / length.mean()
    out = {}
    for c in CONFIGS:
        by = relative[:, None] if c[2] == "1" else 1.0
        x = 2.2 * values / (values + 1.2 * by) if c[1] == "1" else values / by
        out[c] = queries @ (x * idf if c[0] == "1" else x).T
    return out


def ranked(matrix, k):
    values, queries, features, items, asked = matrix
    rows = stats.item_stats(features, items)
    postings = scoring.weighted_postings(features, stats.feature_stats(features), rows, stats.collection_stats(rows))
    return search.top_k(scoring.by_config(scoring.scores(asked, postings)), k)


def test_postings_equal_exhaustive_scores(matrix):
    want = exhaustive(matrix[0], matrix[1])
    got = {(r.query, r.config, r["item"]): r.score for r in ranked(matrix, 1000).collect()}
    for c, s in want.items():
        for (q, i), v in np.ndenumerate(s):
            assert abs(got.get((str(q), c, str(i)), 0.0) - v) < 1e-9


@pytest.mark.parametrize("exclude", [False, True])
def test_zero_padding(matrix, exclude):
    want, k = exhaustive(matrix[0], matrix[1]), 30
    own = ranked(matrix, 1000)
    own = search.top_k(own.drop("rank"), k, exclude=F.col("item") == F.col("query")) if exclude else search.top_k(own.drop("rank"), k)
    groups = own.select("query", "config")
    got = {}
    for r in search.zero_padded(own, groups, matrix[3], k, exclude_self=exclude).collect():
        got.setdefault((r.query, r.config), {})[r["rank"]] = r["item"]
    for (q, c), places in got.items():
        order = sorted((i for i in range(40) if not exclude or str(i) != q), key=lambda i: (-round(want[c][int(q), i], 9), str(i)))
        assert [places[p] for p in range(1, k + 1)] == [str(i) for i in order[:k]]
    assert len(got) == 6 * 8


def test_only_short_rankings_are_padded(spark, monkeypatch):
    """F8: a group with k items above 0 costs no padding; an item that rounds to 0 gives way to smaller ids as in SQL."""
    own = [("full", "111", f"d{i}", 2.0, i) for i in range(1, 6)] + [("tiny", "111", f"d{i}", 2.0 if i < 8 else 1e-12, i) for i in range(4, 9)]
    own = spark.createDataFrame(own, "query string, config string, item string, score double, rank int")
    groups = spark.createDataFrame([(q, "111") for q in ("full", "tiny", "none")], "query string, config string")
    items = spark.createDataFrame([(f"d{i}",) for i in range(1, 10)], "item string")
    ordered, taken = search.top_k, []
    monkeypatch.setattr(search, "top_k", lambda rows, *a: taken.append(rows) or ordered(rows, *a))
    got = {}
    for r in search.zero_padded(own, groups, items, 5).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r["item"])
    assert got == {"full": ["d1", "d2", "d3", "d4", "d5"], "tiny": ["d4", "d5", "d6", "d7", "d1"], "none": ["d1", "d2", "d3", "d4", "d5"]}
    assert taken[0].where("query = 'full'").count() == 5


def test_shards_merge_to_the_whole(matrix):
    rows = ranked(matrix, 1000).drop("rank")
    parts = [search.top_k(rows.where(F.col("item").cast("int") % 3 == m), 10) for m in range(3)]
    key = lambda df: sorted(map(tuple, df.select("query", "config", "rank", "item").collect()))
    assert key(search.merged(*parts, k=10)) == key(search.top_k(rows, 10))
    with pytest.raises(Exception, match="in two shards"):
        search.merged(parts[0], parts[0], k=10).collect()


def test_constant_length_is_inert_and_000_is_identity(spark):
    rows = [(str(i), f"f{(i + j) % 7}", float(1 + j)) for i in range(20) for j in range(3)]
    df = spark.createDataFrame(rows, "item string, feature string, value double")
    items = df.select("item").distinct()
    lengths = stats.item_stats(df, items)
    postings = scoring.weighted_postings(df, stats.feature_stats(df), lengths, stats.collection_stats(lengths))
    for r in postings.select("value", *[x.alias(c) for c, x in scoring.lattice().items()]).collect():
        assert all(abs(r[c[:2] + "0"] - r[c[:2] + "1"]) < 1e-12 for c in CONFIGS)
        assert r["000"] == r["value"]


def test_sparsify_with_ties(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 3, (30, 12))
    df = spark.createDataFrame([(str(i), j, float(v)) for (i, j), v in np.ndenumerate(values.astype(float)) if v], "item string, feature bigint, value double")
    got = {}
    for r in sparse.sparsify(df, 4).collect():
        got.setdefault(r["item"], set()).add(r.feature)
    for i, row in enumerate(values):
        order = np.lexsort((np.arange(12), -row))
        assert got.get(str(i), set()) == {int(j) for j in order[:4] if row[j]}
    assert sparse.sparsify(df, None).count() == df.count()
    assert sparse.ranked_features(df).where("feature_rank <= 4").count() == sparse.sparsify(df, 4).count()


def test_canonical(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 0.0)], "item string, feature string, value double")
    assert [tuple(r) for r in sparse.canonical(df).collect()] == [("a", "x", 3.0)]
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="not a weight"):
            sparse.canonical(spark.createDataFrame([("a", "x", bad)], "item string, feature string, value double")).collect()


def test_diagnostics(spark, matrix):
    values, _, features, items, _ = matrix
    rows = stats.feature_stats(features)
    mass = np.sort(np.concatenate([values.sum(0), np.zeros(5)]))
    n = len(mass)
    want = 2 * (np.arange(1, n + 1) * mass).sum() / (n * mass.sum()) - (n + 1) / n
    assert abs(stats.gini(rows, "mass", dead=5).first().gini - want) < 1e-12
    assert stats.gini(rows.where("false"), "mass").first().gini == 0
    df = np.sort((values > 0).sum(0))[::-1]
    x, y = np.log(np.arange(1, len(df) + 1)), np.log(df)
    got = stats.zipf(rows).first()
    assert abs(got.frequency_slope + np.polyfit(x, y, 1)[0]) < 1e-9 and abs(got.r2 - np.corrcoef(x, y)[0, 1] ** 2) < 1e-9
    own = stats.item_stats(features, items)
    assert own.where("item = '7'").first().length == 0 and stats.collection_stats(own).first().n_items == 40
    empty = stats.collection_stats(own.where("false")).first()
    assert (empty.n_items, empty.avg_length) == (0, 0.0)
    act = stats.activity(rows, stats.collection_stats(own), 30).first()
    assert act.live_features == 25 and abs(act.dead_feature_fraction - 1 / 6) < 1e-12
    assert sorted(r.df for r in stats.shuffled_df(rows).collect()) == sorted(r.df for r in rows.collect())


def test_metrics(spark):
    rankings = spark.createDataFrame([("q", "111", i, f"d{i}") for i in range(1, 201)] + [("z", "111", 1, "d1")], "query string, config string, rank int, item string")
    qrels = spark.createDataFrame([("q", "d2", 2), ("q", "d12", 1), ("q", "gone", 1), ("z", "d1", 0), ("q", "d3", -1)], "query string, item string, grade int")
    got = {r.query: r for r in metrics.judged(rankings, qrels).collect()}
    ideal = 2 + 1 / np.log2(3) + 1 / np.log2(4)
    assert abs(got["q"].ndcg10 - 2 / np.log2(3) / ideal) < 1e-12 and got["q"].mrr10 == 0.5
    assert abs(got["q"].recall100 - 2 / 3) < 1e-12
    assert (got["z"].ndcg10, got["z"].mrr10, got["z"].recall1000) == (0, 0, 0)


def test_ideal_from_counts_of_grades(spark):
    """No window goes over a query's judgments, of which a frequent passage has as many as there are documents."""
    rankings = spark.createDataFrame([("q", "111", i, f"d{i}") for i in range(1, 11)], "query string, config string, rank int, item string")
    qrels = spark.createDataFrame([("q", f"d{i}", 3 if i < 4 else 2 if i < 7 else 1) for i in range(1, 40)] + [("q", "e", None)], "query string, item string, grade int")
    out = metrics.judged(rankings, qrels)
    assert "row_number" not in out._jdf.queryExecution().toString()
    r = out.first()
    assert abs(r.ndcg10 - 1) < 1e-12 and abs(r.recall1000 - 10 / 39) < 1e-12
    ideal = sum(g / np.log2(p + 2) for p, g in enumerate([3, 3, 3, 2, 2, 2, 1, 1, 1, 1]))
    last = metrics.judged(rankings.where("rank = 10"), qrels).first()
    assert abs(last.ndcg10 - 1 / np.log2(11) / ideal) < 1e-12


def test_agreement_and_f1(spark):
    a = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 11)], "query string, item string, rank int")
    b = spark.createDataFrame([("q", f"d{i + 4}", i) for i in range(1, 11)], "query string, item string, rank int")
    assert abs(metrics.agreement(a, b).first().disagreement - 0.4) < 1e-12
    pairs = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c"]), (2, [], []), (3, ["x"], [])], "k int, x array<string>, y array<string>")
    assert {r.k: r.f1 for r in metrics.token_f1(pairs, "x", "y", "k").collect()} == {1: 0.4, 2: 1.0, 3: 0.0}


def test_effects(spark):
    one = spark.createDataFrame([("q", *map(float, range(8)))], ["query", *CONFIGS])
    r = effects.paired_effect(one).first()
    assert r.delta == 7 and abs(r.margin - 7 / np.std(range(8))) < 1e-12
    flat = spark.createDataFrame([("q", *[1.0] * 8)], ["query", *CONFIGS])
    assert effects.paired_effect(flat).first().margin is None and effects.responsive(flat).first()[0] == 0
    assert effects.responsive(one).first()[0] == 3
    p = spark.createDataFrame([("a", 0.04), ("b", 0.001), ("c", 0.03)], "test string, p double")
    assert {r.test: round(r.p_adjusted, 9) for r in effects.holm(p).collect()} == {"a": 0.06, "b": 0.003, "c": 0.06}
    main = one.select(*effects.main_effects(one)).first()
    assert tuple(main) == (4.0, 2.0, 1.0)


def test_shapley_axioms(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(20, 8))
    values[:10, 4:] = values[:10, :4]  # idf is a null player
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], ["query", *CONFIGS])
    got = {r.query: np.array(r[1:]) for r in df.select("query", *effects.shapley()).collect()}
    for i, v in enumerate(values):
        want = np.zeros(3)
        for order in itertools.permutations(range(3)):
            on = 0
            for s in order:
                want[s] += (v[on | 4 >> s] - v[on]) / 6
                on |= 4 >> s
        assert np.allclose(got[i], want)
        assert abs(got[i].sum() - (v[7] - v[0])) < 1e-9
    assert all(abs(got[i][0]) < 1e-12 for i in range(10))


def test_integrity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert [tuple(r) for r in integrity.duplicate_keys(a, "k").collect()] == [(1, 2)]
    assert sorted(map(tuple, integrity.coverage(a, b).collect())) == [(1, "missing"), (2, "missing"), (3, "unexpected")]
    assert [tuple(r) for r in integrity.dangling(a, b, "k", allowed={"2": "withdrawn"}).collect()] == [(2, "withdrawn")]
    with pytest.raises(ValueError, match="twice"):
        integrity.require_empty(integrity.duplicate_keys(a, "k"), "twice")
    with pytest.raises(ValueError):
        integrity.require_count(a, 2, "rows")
    with pytest.raises(ValueError):
        integrity.disjoint_union(a, b, "k")
    assert integrity.disjoint_union(a, b.where("k = 3"), "k").count() == 4


def test_samples(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    pick = lambda d: sorted(r.k for r in sampling.bottom_hash(d, F.col("k"), 40, "s").collect())
    assert pick(df) == pick(df.orderBy(F.rand(3)).repartition(9)) and len(pick(df)) == 40
    parts = {r.part: r["count"] for r in sampling.split(df, F.col("k"), 0.1, "0").groupBy("part").count().collect()}
    assert parts == {"validation": 50, "train": 450}
    assert sampling.split(df.limit(3), F.col("k"), 0.1, "0").where("part = 'validation'").count() == 1
    assert sampling.split(df.where("false"), F.col("k"), 0.1, "0").count() == 0
    assert [r.k for r in sampling.systematic(df, [F.col("k")], 7).orderBy("k").collect()] == list(range(0, 500, 7))
    groups = df.withColumn("g", (F.col("k") % 4).cast("string"))
    got = sampling.quota(groups, "g", F.col("k"), 5, 12, "q")
    assert got.count() == 12 and got.groupBy("g").count().agg(F.max("count")).first()[0] <= 5


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 16)))], "item string, vector array<double>")


def test_bases(dense):
    n = {r["item"]: r.n for r in bases.product_quantised(dense, 16, 4, 5).groupBy("item").agg(F.sum("value").alias("n")).collect()}
    assert set(n.values()) == {4.0} and len(n) == 120
    n = {r["item"]: r.n for r in bases.residual_quantised(dense, 3, 5).groupBy("item").agg(F.sum("value").alias("n")).collect()}
    assert set(n.values()) == {3.0}
    soft = bases.kmeans(dense, 6, 3)
    assert soft.where("value < 0").count() == 0 and soft.groupBy("item").agg(F.sum("value").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    back = bases.identity(dense).withColumn("d", F.col("feature") % 16).withColumn("x", F.when(F.col("feature") < 16, F.col("value")).otherwise(-F.col("value")))
    vectors = {r["item"]: r.vector for r in dense.collect()}
    assert all(abs(vectors[r["item"]][r.d] - r.x) < 1e-12 for r in back.collect())
    assert bases.random(dense, 16, 8).where("value <= 0").count() == 0
    assert bases.pca(dense, 4).agg(F.max("feature")).first()[0] <= 7
    code = bases.autoencoder(dense, np.eye(16), np.zeros(16), np.zeros(16), 3)
    assert code.groupBy("item").count().where("count > 3").count() == 0
    with pytest.raises(ValueError):
        bases.centers(dense, 1000)
    assert abs(bases.scaled(soft).agg(F.percentile("value", F.lit(0.5))).first()[0] - 1) < 1e-9


def test_pooled_and_summed_differ(spark):
    states = spark.createDataFrame([("a", [1.0, -1.0]), ("a", [-1.0, 1.0])], "item string, vector array<double>")
    assert bases.identity(bases.pooled(states)).count() == 0
    assert bases.summed(bases.identity(states)).agg(F.sum("value")).first()[0] == 4.0


def test_regression_and_resampling(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    m = statistics.ridge(x, y, 1e-9)
    a = np.column_stack([x, np.ones(60)])
    assert np.allclose(statistics.predict(m, x), a @ np.linalg.lstsq(a, y, rcond=None)[0], atol=1e-6)
    twice = statistics.ridge(np.vstack([x, x[:10]]), np.append(y, y[:10]), 2.0)
    weighted = statistics.ridge(x, y, 2.0, np.where(np.arange(60) < 10, 2.0, 1.0))
    assert np.allclose(statistics.predict(twice, x), statistics.predict(weighted, x))
    b = statistics.bootstrap(np.tile(np.arange(8.0), (5, 1)), 200)
    assert b["delta"] == 7 and b["low"] == b["high"] == 7 and abs(b["margin"] - 7 / np.std(range(8))) < 1e-9
    low, high = statistics.cluster_bootstrap(__import__("pandas").DataFrame({"a": [1, 1, 2, 2], "b": [1, 2, 1, 2], "v": [1.0] * 4}), "a", "b", "v", 50)
    assert low == high == 1.0


def test_held_out_groups_do_not_leak(spark):
    rows = [(f"{g}{i}", g, f"i{i % 3}", float(i), float(i) + (100.0 if g == "c" else 0.0)) for g in "abc" for i in range(12)]
    df = spark.createDataFrame(rows, "key string, fold_of string, inner string, x double, y double")
    got = statistics.grouped_validation(df, ["x"], "y", "fold_of", "inner", "key").toPandas()
    assert len(got) == 36 and got[got.fold == "c"].estimate.max() < 30
    model = statistics.ridge(np.array([[r[3]] for r in rows]), np.array([r[4] for r in rows]), 1.0)
    frozen = statistics.frozen_predict(df, model, ["x"]).toPandas()
    assert np.allclose(frozen.estimate, statistics.predict(model, frozen[["x"]].to_numpy()))


def test_pages(spark):
    keys = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(20)], "position bigint, vector array<double>")
    pages = {r.page: r for r in selection.page_summary(keys, 8).collect()}
    assert [pages[p].tokens for p in range(3)] == [8, 8, 4] and pages[1].low == [8.0, -15.0] and pages[1].high == [15.0, -8.0]
    scored = spark.createDataFrame([(1, p, 4 if p == 5 else 8, s) for p, s in enumerate([1.0, 5.0, 5.0, 2.0, 9.0, 0.0])], "unit int, page bigint, tokens bigint, score double")
    chosen = lambda **k: sorted(r.page for r in selection.select_pages(scored, page=8, **k).collect())
    assert chosen(budget=28) == [1, 2, 4, 5]  # 4 tokens are charged for the last page, and three whole pages fit
    assert set(chosen(budget=20, sink=True)) == {0, 4, 5} and chosen(budget=3) == [5]
    assert selection.positions(selection.select_pages(scored, 20, 8), 8).count() == 20


def test_routing_without_correction_is_native(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(u, e, float(x)) for (u, e), x in np.ndenumerate(rng.normal(size=(30, 6)))], "unit bigint, expert bigint, logit double")
    p = selection.softmax(rows, "logit").withColumn("score", scoring.corrected(F.col("logit") * 0 + F.col("p"), F.lit(2.0), F.lit(3.0), F.lit(5), "000"))
    key = lambda d: sorted((r.unit, r.expert, round(r.weight, 12)) for r in d.collect())
    assert key(selection.route(p, "score", 2)) == key(selection.route(p, "p", 2))
    assert p.groupBy("unit").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-12").count() == 0
    forced = selection.route(p, "p", 2, forced=F.col("expert") == 3)
    assert forced.where("expert = 3").count() == 30


def test_text(spark):
    cases = ["Straße ÉTÉ", "été A1_b", "", None, "日本 語x", "ﬁne ΑΣ"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: r.l for r in df.select("i", text.tokens(F.col("t")).alias("l")).collect()}
    assert got[0] == ["strasse", "été"] and got[1] == ["été", "a1", "b"] and got[2] == [] == got[3]
    assert {r.i: r.l for r in df.where("i < 1").select("i", text.tokens(F.col("t")).alias("l")).collect()} == {0: got[0]}
    one = spark.createDataFrame([("  A title\n", " body ", "1,234 and -5.5", "q")], "a string, b string, n string, q string")
    r = one.select(text.content(F.col("a"), F.col("b")).alias("c"), text.last_number(F.col("n")).alias("n"), text.last_number(F.col("q")).alias("none"), text.choices_prompt(F.col("q"), F.array(F.lit("x"), F.lit("y"))).alias("p")).first()
    assert (r.c, r.n, r.none, r.p) == ("A title\nbody", -5.5, None, "q\nA. x\nB. y\nAnswer:")
    score = lambda anyof, *refs: one.select(text.reference_score(F.col("b"), F.array(*map(F.lit, refs)), F.lit(anyof)).alias("s")).first().s
    assert score(False, "BODY", "no") == 0.5 and score(True, "BODY", "no") == 1.0 and score(True, "no") == 0.0
    assert abs(one.select(numeric.smoothed_idf(F.lit(10), F.lit(0)).alias("x")).first().x - np.log1p(10.5 / 0.5)) < 1e-12
