import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tallyloom.llm import quality

GOOD = [f"plain{i}" for i in range(400)]


def corpus(n=4000, seed=0):
    """(doc_id, text), (doc_id, quality, toxic): prose, prose with a few toxic words, and junk of the same words."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randrange(30, 200))]
        kind = rng.choices(["good", "junk", "toxic"], [7, 2, 1])[0]
        if kind == "junk":
            words = [w + rng.choice(["***", "%%%", "###"]) for w in words]
        if kind == "toxic":
            for _ in range(4):
                words[rng.randrange(len(words))] = f"slur{rng.randrange(8)}"
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return docs, labels, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(tables):
    docs, labels, df, marks = tables
    got = {r.doc_id: r for r in quality.weights(df, marks.where("doc_id % 2 = 0")).collect()}
    assert len(got) == len(docs)
    held = [(bool(q and not t), got[i].keep) for i, q, t in labels if i % 2]
    assert sum(k for g, k in held if g) >= 0.99 * sum(g for g, _ in held)
    assert sum(not k for g, k in held if not g) >= 0.9 * sum(not g for g, _ in held)
    kept = {r.doc_id for r in quality.keep(df, marks.where("doc_id % 2 = 0")).collect()}
    assert kept == {i for i, r in got.items() if r.keep}


def test_reruns_and_partitions_agree(tables):
    _, _, df, marks = tables
    one = {r.doc_id: (r.log_weight, r.gumbel_key, r.keep) for r in quality.weights(df, marks).collect()}
    two = {r.doc_id: (r.log_weight, r.gumbel_key, r.keep) for r in quality.weights(df.repartition(13), marks.repartition(3)).collect()}
    assert one == two


def test_threshold_is_the_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), [-1e9, 1e9]])
    keys = spark.createDataFrame([(float(v),) for v in values], "_key double")
    order = np.sort(values)[::-1]
    for k in (1, 2, 700, 1300, 3000, len(values)):
        assert quality.threshold(keys, k, bins=8) == order[k - 1]
    assert quality.threshold(keys, 0) == float("inf")


def test_a_group_of_copies_counts_once(spark):
    docs = [(i, "the same words again and again") for i in range(3000)] + [(i, f"words {i} of {i * 7} own sort here") for i in range(3000, 4000)] + [(4000, None), (4001, "")]
    labels = spark.createDataFrame([(i, 1, int(i < 2000 or i >= 3000)) for i, _ in docs], "doc_id bigint, quality int, toxic int")
    got = quality.labelled(spark.createDataFrame(docs, "doc_id bigint, text string"), labels, id_col="doc_id", text_col="text", max_labels=10_000)
    assert sorted((r.bad, round(r.w, 6)) for r in got.groupBy("bad").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "w").collect()) == [(False, 1.0), (True, 1002.0)]


def grams(text):
    """Unigrams and bigrams by plain Python, and the runs that repeat one to three tokens."""
    words = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", (text or "").lower())
    out = set(words) | set(zip(words, words[1:]))
    for period in (1, 2, 3):
        run = 0
        for a, b in zip(words, words[period:]):
            run = run + 1 if a == b else 0
            out |= {(period, run)} if run in (2, 6, 24) else set()
    return out


def by_brute_force(docs, marks, seed=0):
    """{doc_id: (log weight, key)} and the drawn ids."""
    bad = {i: not q or bool(t) for i, q, t in marks}
    sets = {i: grams(t) for i, t in docs}
    copies = Counter((bad[i], dict(docs)[i]) for i, _ in docs if i in bad)
    raw, counts, mass = Counter(), {True: Counter(), False: Counter()}, {True: 0.0, False: 0.0}
    for i, text in docs:
        raw.update(sets[i])
        if i in bad:
            w = 1 / copies[bad[i], text]
            mass[bad[i]] += w * len(sets[i])
            for g in sets[i]:
                counts[bad[i]][g] += w
    ratio = {}
    for g, n_bad in counts[True].items():
        expected, n = raw[g] * mass[False] / sum(raw.values()), counts[False][g]
        rare = (n + 1) / (expected + 1) <= 0.1 and expected - n >= 5 * math.sqrt(expected + 1)
        alike = (n_bad + n) * mass[False] / (mass[True] + mass[False])
        rare = rare and alike - n >= 5 * math.sqrt(alike + 1)
        if n_bad >= 8 - 1e-9 and rare and n_bad >= 10 * (n + 1) * mass[True] / mass[False]:
            ratio[g] = max(math.log((n + 1) / (expected + 1)), -math.log(100))
    out = {}
    for i, _ in docs:
        w = sum(ratio.get(g, 0.0) for g in sets[i])
        u = int(hashlib.sha256(f"quality:{seed}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        out[i] = w, w - math.log(-math.log(u))
    k = round(sum(min(1.0, math.exp(w)) for w, _ in out.values()))
    return out, set(sorted(out, key=lambda i: -out[i][1])[:k])


def test_weights_and_draw_against_brute_force(spark):
    rng = random.Random(3)
    docs, marks = corpus(1600, seed=3)
    docs = [(i, t if i % 5 else " ".join(t.split()[:12]) + (" slur1 slur2" if i % 10 == 0 else "")) for i, t in docs]
    marks = [(i, q, int(t or (i % 5 == 0 and i % 10 == 0))) for i, q, t in marks if rng.random() < 0.6]
    docs += [(2000 + i, docs[7][1]) for i in range(40)]
    marks += [(2000 + i, 0, 1) for i in range(40)]
    want, drawn = by_brute_force(docs, marks)
    got = {r.doc_id: r for r in quality.weights(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")).collect()}
    assert all(abs(got[i].log_weight - w) < 1e-6 and abs(got[i].gumbel_key - key) < 1e-6 for i, (w, key) in want.items())
    assert {i for i, r in got.items() if r.keep} == drawn and 1000 < len(drawn) < 1500
    # the draw decides, not the weight alone: some of the weighed-down documents stay
    assert any(r.keep for r in got.values() if r.log_weight < 0) and len({round(w, 6) for w, _ in want.values()}) > 3


def test_given_budget(spark):
    docs, marks = corpus(600)
    df, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    for k in (0, 1, 100, 600):
        assert quality.keep(df, labels, k=k).count() == k
    a, b = ({r.doc_id for r in quality.keep(df, labels, k=100, seed=s).collect()} for s in (0, 1))
    assert len(a & b) < 60


def copied(n_copies, seed=1):
    """Prose, a tenth with toxic words, and copies of one toxic text: as ``corpus``, and which ids are copies."""
    docs, labels = corpus(seed=seed)
    words = [random.Random(5).choice(GOOD) for _ in range(120)]
    for at in range(10, 90, 10):
        words[at] = f"slur{at // 10 - 1}"
    n = len(docs)
    docs += [(n + i, " ".join(words)) for i in range(n_copies)]
    labels += [(n + i, 1, 1) for i in range(n_copies)]
    return docs, labels, n


@pytest.mark.parametrize("n_copies", [0, 2500])
def test_copies_take_no_evidence_away(spark, n_copies):
    docs, labels, n = copied(n_copies)
    df, marks = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in quality.weights(df, marks).collect()}
    toxic = [keep[i] for i, _, t in labels if t and i < n]
    good = [keep[i] for i, q, t in labels if q and not t]
    assert not any(keep[i] for i in range(n, n + n_copies))
    assert sum(toxic) <= 0.05 * len(toxic) and sum(good) >= 0.96 * len(good)


def test_copies_alone_are_no_evidence(spark):
    docs, labels = corpus()
    n = len(docs)
    # many copies of one text of prose that is labelled toxic, and no other sign of it
    own = " ".join(random.Random(6).choice(GOOD) for _ in range(120))
    docs = docs + [(n + i, own) for i in range(2500)]
    labels = labels + [(n + i, 1, 1) for i in range(2500)]
    df, marks = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in quality.weights(df, marks).collect()}
    good = [keep[i] for i, q, t in labels if q and not t]
    assert sum(good) >= 0.96 * len(good)


def test_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (99, 1, 1), (8, 1, None)], "doc_id bigint, quality int, toxic int")
    got = quality.weights(docs, labels).collect()
    assert len(got) == docs.count()
    out = quality.keep(docs, labels)
    assert out.columns == docs.columns and out.count() == sum(r.keep for r in got)
    none = labels.where("false")
    assert all(r.keep and r.log_weight == 0 for r in quality.weights(docs, none).collect())
    assert quality.weights(no_docs, labels).count() == 0 and quality.keep(no_docs, labels).count() == 0
