import json
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tallyloom import config
from tallyloom.functions import text
from tallyloom.functions.numeric import CONFIGS
from tallyloom.operators import effects, sampling, search, statistics, summaries
from tallyloom.plans import grid
from tallyloom.sources import collections


def test_tokens_of_any_unicode_text(spark):
    texts = ["Plain ASCII, twice: 12a", "Straße CAFÉ café", "İstanbul Σς", None, "", "กำ ①x", "áb_c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.l for r in df.select("i", text.tokens(F.col("t")).alias("l")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == regex.findall(r"[\p{L}\p{N}\p{M}]+", unicodedata.normalize("NFC", t or "").casefold())


def wide(spark, rows, weights=None):
    columns = [*CONFIGS, *(["weight"] if weights else [])]
    data = [(*map(float, r), *([float(weights[i])] if weights else [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"`{c}` double" for c in columns))


def test_weighted_effect_and_responsive_switches(spark):
    rows = [range(8), [2 * x for x in range(8)]]
    got = effects.weighted_effect(wide(spark, rows, [1, 3])).first()
    assert got.delta == 12.25 and abs(got.margin - 7 / np.std(range(8))) < 1e-12
    assert effects.responsive_on_average(wide(spark, rows)).first()[0] == 3
    # two keys that move against each other leave the average as it is
    flat = [[0, 1, 0, 1, 0, 1, 0, 1], [1, 0, 1, 0, 1, 0, 1, 0]]
    assert effects.responsive_on_average(wide(spark, flat)).first()[0] == 0 and effects.responsive(wide(spark, flat)).first()[0] == 1


def test_precision_weights_with_zeros(spark):
    def weights(values):
        return [r.weight for r in effects.precision_weights(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, variance double")).orderBy("i").collect()]

    assert weights([0.0, 0.0, None]) == [1.0, 1.0, 1.0]
    for values in ([0, 0, 0, 4], [1, 2, 3, 0], [1e-9, 1, 1, 1, 100]):
        floor = np.median([v for v in values if v > 0]) / 20
        w = 1 / np.maximum(values, floor)
        w = np.minimum(w, np.median(w) * 20)
        assert np.allclose(weights([float(v) for v in values]), w / w.mean())


def test_choose_alpha():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=30)
    assert statistics.choose_alpha(x, y, np.zeros(30)) == 1.0
    groups = np.array([0] * 20 + [1] * 10)
    errors = []
    for alpha in statistics.ALPHAS:
        each = []
        for g in (0, 1):
            m = statistics.ridge(x[groups != g], y[groups != g], alpha)
            each.append(np.abs(statistics.predict(m, x[groups == g]) - y[groups == g]).mean())
        errors.append(np.mean(each))
    assert statistics.choose_alpha(x, y, groups) == statistics.ALPHAS[int(np.argmin(errors))]
    # every group leaves one row only: nothing to choose by
    assert statistics.choose_alpha(x[:2], y[:2], np.array([0, 1])) == statistics.ALPHAS[0]


def test_margin_variance_is_a_samples():
    values = np.random.default_rng(2).normal(size=(40, 8))
    got = statistics.bootstrap(values, draws=50, seed=3)
    means = np.random.default_rng(3).multinomial(40, np.full(40, 1 / 40), 50) @ values / 40
    assert abs(got["margin_variance"] - np.var((means[:, -1] - means[:, 0]) / means.std(1), ddof=1)) < 1e-12


def test_judgments_of_every_form(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("query_id doc_id grade\nq1 d1 2\nq1 d2 0\n")
    (tmp_path / "b.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n\nq2 0 d3 1\n")
    (tmp_path / "c.jsonl").write_text('{"query-id": "q1", "corpus-id": "d1", "score": 1}\n')
    read = lambda n: sorted(tuple(r) for r in collections.qrels(spark, str(tmp_path / n)).collect())
    assert read("a.tsv") == [("q1", "d1", 2), ("q1", "d2", 0)]
    assert read("b.tsv") == [("q1", "d1", 2), ("q2", "d3", 1)]
    assert read("c.jsonl") == [("q1", "d1", 1)]


FULL = {
    "schema_version": 1, "encoder": {"kind": "given"}, "fitting": {}, "bases": [{"name": "a"}, {"name": "b"}],
    "datasets": {"x": {"source": "ir_datasets", "id": "beir/x", "corpus_id": "x", "language": "en", "role": "fit"}, "y": {"source": "local", "corpus_id": "y", "language": "en", "role": "evaluate"}},
    "budgets": [{"name": "small", "query": 32, "document": 64, "primary": True}, {"name": "none", "query": None, "document": None}],
}


def test_configuration_with_datasets_by_name(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps(FULL))
    (tmp_path / "own.json").write_text(json.dumps({"extends": "base.json", "datasets": {"y": {"enabled": False}}, "budgets": FULL["budgets"][:1]}))
    got = config.validated(config.load(str(tmp_path / "own.json")))
    assert got["datasets"]["x"]["exclude_identical_ids"] and not got["datasets"]["y"]["exclude_identical_ids"]
    assert got["datasets"]["y"] == FULL["datasets"]["y"] | {"enabled": False, "exclude_identical_ids": False} and len(got["budgets"]) == 1
    for wrong in (
        {"budgets": [{"name": "a", "query": 0, "document": 1}]}, {"budgets": [{"name": "a", "query": 1, "document": 1.5}]}, {"budgets": FULL["budgets"][:1] * 2}, {"bases": [{"name": "a"}] * 2},
        {"datasets": {"x": {"source": "local"}}}, {"datasets": {"y": FULL["datasets"]["y"]}}, {"encoder": {"kind": "fixture"}}, {"datasets": {"x": {k: v for k, v in FULL["datasets"]["x"].items() if k != "id"}}},
    ):
        with pytest.raises(ValueError):
            config.validated(FULL | wrong)
    (tmp_path / "loop.json").write_text(json.dumps({"extends": "loop.json"}))
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "loop.json"))
    assert config.overlaid([{"a": {"b": 1}}, {"a": 2}, {"a": {"c": 3}}]) == {"a": {"c": 3}}


def test_families_of_the_grid():
    spec = FULL | {"experiments": {"robustness_collections": ["y"], "stochastic_bases": ["b"], "parameter_collections": ["y"]}}
    n = {f: len(grid.family(spec, f)) for f in grid.FAMILIES}
    assert n == {"primary": 4, "sparsity": 8, "robustness": 4, "parameters": 36, "controls": 0, "shared_sae": 0}
    # primary cells are also cells of the other two
    assert len(grid.family(spec, "all")) == 8 + 4 + 36 - 4
    with pytest.raises(ValueError):
        grid.family(spec, "other")


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(f"v{i}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]
    df = spark.createDataFrame(vectors, "item string, vector array<double>")
    asked = df.withColumnRenamed("item", "query")
    want = {}
    for q, a in vectors:
        order = sorted((-round(float(np.dot(a, b)), 9), i) for i, b in vectors if i != q)
        want[q] = [i for _, i in order[:7]]
    for query_block, vector_block in ((16_384, 4_096), (50, 20)):
        monkeypatch.setattr(search, "QUERY_BLOCK", query_block)
        monkeypatch.setattr(search, "VECTOR_BLOCK", vector_block)
        got = {}
        for r in search.dense_top_k(asked, df, 7).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["item"])
        assert got == want
    assert search.dense_top_k(asked.where("false"), df, 7).count() == 0


def test_split_by_counts_is_exact(spark):
    for n in (0, 1, 7, 1000):
        rows = spark.range(n).withColumnRenamed("id", "k")
        got = sampling.split(rows, F.col("k"), 0.1, "s").groupBy("part").count().collect()
        assert {r.part: r["count"] for r in got}.get("validation", 0) == (max(1, n // 10) if n else 0) and sum(r["count"] for r in got) == n


def test_tables_of_results(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, None)], "k int, g string, v double")
    assert [r.k for r in summaries.listed(rows, "g", include=["a", "b"], exclude=["b"]).collect()] == [1]
    assert {r.k for r in summaries.listed(rows, "g", exclude=["b"]).collect()} == {1, 3}
    assert [r.excluded_by for r in summaries.eligible(rows, {"named": F.col("g").isNotNull(), "large": F.col("v") > 1}).orderBy("k").collect()] == ["large", None, "named"]
    assert summaries.summary(rows, "v", []).first().median == 1.5
    names = spark.createDataFrame([("niah_1__c4096__b512__sink0",), ("other",)], "name string")
    assert [tuple(r)[1:] for r in summaries.row_names(names, "name").collect()] == [("niah_1", 4096, 512, False), (None, None, None, None)]
    ids = spark.createDataFrame([(0,), (5,), (9,)], "feature bigint")
    assert [(r.code, r.group, r.group_kind) for r in summaries.feature_metadata(ids, "rq", 10, 4).orderBy("feature").collect()] == [(0, 0, "residual_stage"), (1, 1, "residual_stage"), (1, 2, "residual_stage")]
    with pytest.raises(Exception, match="outside the vocabulary"):
        summaries.feature_metadata(ids, "identity", 8).collect()


def test_attention_over_selected_positions(spark):
    rng = np.random.default_rng(7)
    logits, values = rng.normal(size=(3, 5)) * 20, rng.normal(size=(5, 4))
    chosen = [(u, p) for u in range(3) for p in range(5) if (u + p) % 2 == 0]
    got = summaries.attention_output(
        spark.createDataFrame([(u, p, float(logits[u, p])) for u, p in chosen], "unit int, position int, logit double"),
        spark.createDataFrame([(p, d, float(values[p, d])) for p in range(5) for d in range(4)], "position int, d int, value double"),
    ).collect()
    for r in got:
        own = [p for u, p in chosen if u == r.unit]
        w = np.exp(logits[r.unit, own] - logits[r.unit, own].max())
        assert abs(r["value"] - (w / w.sum()) @ values[own, r.d]) < 1e-9
    assert len(got) == 12
