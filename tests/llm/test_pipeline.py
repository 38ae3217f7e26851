"""The pipeline, stage by stage and as a whole, against plain Python."""

import hashlib
import math
import random
import re

import pytest

from test_decontam import infix
from test_mixing import level
from test_neardup import classes_by_brute_force, varied

SECRET = re.compile(r"((?i:password|passwd|secret|token|api_?key))([\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)")


@pytest.fixture(scope="module")
def world(spark, sf):
    rng = random.Random(11)
    words = [f"plain{i}" for i in range(2500)]
    items = [[rng.choice(words) for _ in range(30)] for _ in range(12)]
    docs, good = [], {}
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        bad = rng.random() < 0.25
        if bad:
            text = [w + rng.choice(["***", "%%%", "###"]) for w in text]
        elif i % 9 == 0:
            text[20:20] = rng.choice(items)
        elif i % 7 == 0:
            text.insert(5, f"password=Zx9{i}abcdefgh{i}QW")
        elif i % 5 == 0 and docs and good[docs[-1][0]]:
            text = varied(docs[-1][1].split(), 0.01, rng)
        good[i] = not bad
        docs.append((i, " ".join(text), "en", f"s{min(i % 11, 6)}", 0))
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "labels": spark.createDataFrame([(i, int(g), 0) for i, g in good.items() if i % 3], "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string"),
    }
    return docs, good, items, sf(**tables)


def redacted(rows):
    owners = {}
    for _, text, _, source, _ in rows:
        for m in SECRET.finditer(text):
            owners.setdefault(m[3], set()).add(source)
    # every value of the contract's kinds that few owners have, whatever its shape; the fixture has no placeholders
    live = lambda v: len(owners[v]) < 3 and len(v) >= 8
    return [(i, SECRET.sub(lambda m: m[1] + m[2] + "[SECRET]" if live(m[3]) else m[0], text), lang, source, n) for i, text, lang, source, n in rows]


def mixed(rows):
    sizes, size = {}, {}
    for i, text, _, source, _ in rows:
        size[i] = len(text.split())
        sizes[source] = sizes.get(source, 0) + size[i]
    target = level(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 3)
    out = []
    for r in rows:
        rate = target[r[3]] / sizes[r[3]]
        u = int(hashlib.sha256(f"mix:0:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        out += [(*r, c + 1) for c in range(math.floor(rate) + (u < rate - math.floor(rate)))]
    return out


def test_stages_and_run(spark, world):
    import corpus_pipeline

    docs, good, items, folder = world
    kept = [d for d in docs if good[d[0]]]
    least = classes_by_brute_force([(i, t) for i, t, *_ in kept])
    unique = [d for d in kept if least[d[0]] == d[0]]
    clean = [d for d in unique if all(infix(x, d[1].split()) > 6 for x in items)]
    want = [kept, unique, clean, redacted(clean), mixed(redacted(clean))]
    assert len(kept) > len(unique) > len(clean) > 500 and want[3] != clean
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want, strict=True):
        now = stage(spark, now, folder)
        got = [tuple(r) for r in now.collect()]
        assert sorted(got) == sorted(rows), name
        now = spark.createDataFrame(got, now.schema)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(want[-1])


def test_run_leaves_one_folder(spark, world):
    import corpus_pipeline
    from pathlib import Path

    root = Path(spark.conf.get("spark.checkpoint.dir")) / "tallyloom"
    before = {p.name for p in root.iterdir()} if root.exists() else set()
    out = corpus_pipeline.run(spark, world[3])
    new = [p for p in root.iterdir() if p.name not in before]
    assert len(new) == 1 and [p.name for p in new[0].iterdir()] == ["mix"] and out.count() > 0


def test_a_column_named_as_the_copys_number(spark, docs, sf):
    from pyspark.sql import functions as F
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id bigint, text string")
    out = corpus_pipeline.run(spark, sf(documents=docs.withColumn("mix_copy", F.lit("mine")), labels=labels, benchmark=benchmark))
    assert {r.mix_copy for r in out.collect()} == {"mine"} and "_mix_copy" in out.columns


def test_edges(spark, docs, no_docs, sf):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (None, None)], "item_id bigint, text string")
    for table, n in ((docs, 6), (no_docs, 0)):
        folder = sf(documents=table, labels=labels, benchmark=benchmark)
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, folder)
            assert [c for c in now.columns if c != "mix_copy"] == table.columns, name
        assert now.count() >= 0
        out = corpus_pipeline.run(spark, folder)
        assert out.select("doc_id").distinct().count() <= n
    assert corpus_pipeline.run(spark, sf(documents=docs, labels=labels.where("false"), benchmark=benchmark.where("false"))).count() > 0
