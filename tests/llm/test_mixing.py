import re

from tallyloom.llm import mixing


def level(sizes, weights, cap):
    """Targets by resharing until none is above its cap."""
    target, total = {}, sum(sizes.values())
    todo = set(sizes)
    while True:
        left = total - sum(target.values())
        over = {s for s in todo if left * weights[s] / sum(weights[x] for x in todo) > cap * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / sum(weights[x] for x in todo) for s in todo}
        target |= {s: float(cap * sizes[s]) for s in over}
        todo -= over
        if not todo:
            return target


def test_targets_and_takings(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 5 if i % 3 else 0}") for i in range(3000)]
    rows += [(9000 + i, "w " * 3, "tiny") for i in range(4)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sizes = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", dict((x[0], x[1]) for x in rows)[r.doc_id])) if r.doc_id < 20 else True
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = level(sizes, weights, 3)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r["size"] and r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in ("s0", "s1", "s2"):
        assert abs(taken[s] - want[s]) < 0.1 * want[s]
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    again = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)).collect()
    assert sorted(again) == sorted(got)


def test_edges(spark, docs, no_docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert {r["size"] for r in got if r.doc_id in (3, 4, 5)} == {0}
    one, two = [r for r in got if r.doc_id == 2]
    assert one == two
    assert mixing.mix(no_docs).count() == 0
    emitted = mixing.emit(docs)
    assert emitted.columns == [*docs.columns, "mix_copy"]
    assert emitted.count() == sum(r.copies for r in got)
    assert mixing.emit(no_docs).count() == 0


def test_a_column_named_as_the_copys_number(spark, docs):
    from pyspark.sql import functions as F

    out = mixing.emit(docs.withColumn("mix_copy", F.lit("mine")))
    assert out.columns == [*docs.columns, "mix_copy", "_mix_copy"]
    assert {r.mix_copy for r in out.collect()} == {"mine"} and {r._mix_copy for r in out.collect()} >= {1}
    assert out.count() == mixing.emit(docs).count()
