"""Blockwise operators against the row-wise ones and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import catalog
from tallyloom.operators import blocks, search, selection


def vectors_table(spark, folder, n=203, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, 6)) / 4
    x[20:60] = x[20]  # copies: whole pages of the same score
    rows = [(i, [float(v) for v in x[i]], int(i % 3)) for i in range(n)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return x


@pytest.fixture
def small_blocks(monkeypatch):
    for module, name, value in ((selection, "PAGE_BLOCK", 5), (selection, "UNIT_BLOCK", 7), (search, "SENT_BLOCK", 50), (search, "QUERY_BLOCK", 9), (search, "VECTOR_BLOCK", 20)):
        monkeypatch.setattr(module, name, value)


def test_dense_search_hands_on_k_rows_a_query(spark, tmp_path, small_blocks):
    """ties by the hundred and many blocks don't add rows to what a task holds or hands on."""
    x = vectors_table(spark, str(tmp_path))
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("item"), F.col("embedding").alias("vector"))
    got = {}
    for r in search.dense_top_k(df.withColumnRenamed("item", "query"), df, 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["item"])
    want = {str(q): [i for _, i in sorted((-round(float(x[q] @ x[i]), 9), str(i)) for i in range(len(x)) if i != q)[:5]] for q in range(len(x))}
    assert got == want
    best = blocks.Best(3, 4)
    for at in range(100):
        blocks.top_of_block(best, np.array([f"{at}-{i}" for i in range(5000)], object), np.ones((3, 5000)))
        assert best.n <= best.limit + 3 * 5000
    assert [x for x in best.result()[1][:4]] == ["0-0", "0-1", "0-10", "0-100"]


def test_tops_are_cut_without_sorting_all(monkeypatch):
    """Names are ordered only where many scores are equal to the k-th."""
    rng, best = np.random.default_rng(4), blocks.Best(3, 4)
    best.limit, kept = 50, []
    ranked = blocks.Best._name_rank
    monkeypatch.setattr(blocks.Best, "_name_rank", lambda self: kept.append(len(self.names)) or ranked(self))
    score = rng.permutation(3 * 600).reshape(3, 600) / 7
    for at in range(0, 600, 20):
        blocks.top_of_block(best, np.array([f"n{i}" for i in range(at, at + 20)], object), score[:, at : at + 20])
    assert not kept
    group, name, got = best.result()
    want = [(q, f"n{i}") for q in range(3) for i in np.argsort(-score[q])[:4]]
    assert list(zip(group, name)) == want and np.array_equal(got, [score[q, int(n[1:])] for q, n in want]) and len(kept) == 1


def test_pages_by_blocks_equal_all_pairs(spark, tmp_path, small_blocks):
    """The same pages, scores and shares as from a row for each unit and page."""
    x, d = vectors_table(spark, str(tmp_path)), str(tmp_path)
    low = np.array([x[i : i + 16].min(0) for i in range(0, len(x), 16)])
    high = np.array([x[i : i + 16].max(0) for i in range(0, len(x), 16)])
    score = np.where(x[:, None, :] >= 0, x[:, None, :] * high, x[:, None, :] * low).sum(-1)
    last, size = len(low) - 1, len(x) % 16
    take = (128 - size) // 16
    want = {q: {last, *sorted(range(last), key=lambda p: (-round(score[q, p], 9), p))[:take]} for q in range(len(x))}
    assert {(r.unit, r.page): r.mandatory for r in catalog.QUERIES["page_select"](spark, d).collect()} == {(q, p): p == last for q in want for p in want[q]}
    assert {(r.unit, r.page): r.score for r in catalog.QUERIES["page_criticality"](spark, d).collect()} == {(q, p): round(float(s), 6) for (q, p), s in np.ndenumerate(score)}
    share = {q: sum(np.exp(score[q, p]) for p in want[q]) / np.exp(score[q]).sum() for q in want}
    got = {r.unit: r.mass_share for r in catalog.QUERIES["mass_share"](spark, d).collect()}
    assert got.keys() == share.keys() and all(abs(got[q] - share[q]) < 1e-6 for q in got)
    got = {r.unit: (r.tokens, r.first_position, r.last_position) for r in catalog.QUERIES["page_positions"](spark, d).collect()}
    assert got == {q: (16 * take + size, 16 * min(want[q]), len(x) - 1) for q in want}


def test_no_query_holds_all_pairs(spark, tmp_path):
    """no table of a row for each unit and page is kept, and calibration works on its 64 units."""
    from tallyloom.plans import inputs

    vectors_table(spark, str(tmp_path))
    for name in ("calibration_counts", "mass_share", "page_select", "page_criticality", "page_positions"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count()
    assert not [k for k in inputs._HELD if k[1:] == (str(tmp_path), "criticality")]
    units = spark.createDataFrame([(3,), (70,)], "unit bigint")
    assert catalog._criticality(spark, str(tmp_path), units).select("unit").distinct().count() == 2


def test_repeated_and_null_vectors_take_the_row_wise_way(spark, tmp_path):
    rows = [(i, [float(i % 5), -1.0]) for i in [*range(40), 3]]
    keys = spark.createDataFrame(rows, "position bigint, vector array<float>")
    assert not selection.regular(keys) and selection.regular(keys.distinct())
    assert not selection.regular(keys.distinct().union(spark.createDataFrame([(99, None)], keys.schema)))
    assert not selection.regular(keys.where("false"))
