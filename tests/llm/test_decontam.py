import random

import numpy as np
from tallyloom.llm import decontam


def infix(item, text):
    """Least edit distance of the item to any part of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(words, n, rng, fresh):
    out = list(words)
    for _ in range(n):
        k, p = rng.randrange(3), rng.randrange(len(out))
        if k == 0:
            out[p] = next(fresh)
        elif k == 1:
            out.insert(p, next(fresh))
        else:
            del out[p]
    return out


def test_planted_copies_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    fresh = (f"new{i}" for i in range(10**6))
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([9, 14, 30, 60]))] for _ in range(40)]
    docs, want = [], set()
    for d in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 300))]
        if d % 2 == 0:
            item = items[d % 40]
            at = rng.randrange(len(words))
            words[at:at] = edited(item, rng.randrange(0, int(len(item) * 0.2) + 1), rng, fresh)
        docs.append((d, " ".join(words)))
    for d, text in docs:
        for i, item in enumerate(items):
            if infix(item, text.split()) <= int(len(item) * 0.2 + 1e-9):
                want.add((d, i))
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = decontam.matches(df, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want
    assert len(got) >= 0.97 * len(want) and len(want) >= 75
    for r in rows:
        words = docs[r.doc_id][1].split()
        assert r.edits == infix(items[r.item_id], words)
    kept = {r.doc_id for r in decontam.clean(df, benchmark).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def recall_by_length(texts, n=150):
    """Share of fresh copies at the largest permitted distance that are found, for each length of item."""
    index, rng = decontam.Index(list(range(len(texts))), texts), np.random.default_rng(99)
    own = {}
    for i, x in enumerate(index.items):
        own.setdefault(len(x), []).append(i)
    out = {}
    for size, which in own.items():
        hits = 0
        for i in rng.choice(which, n).tolist():
            words = decontam._edited(index.items[i], int(index.permitted[i]), rng)
            hits += any(j == i for _, j, *_ in index.search(words, np.array([0, len(words)])))
        out[size] = hits / n
    return out


def invented(sizes):
    rng = random.Random(8)
    return [" ".join(f"v{rng.randrange(3000)}" for _ in range(n)) for n in sizes]


def test_recall_holds_for_each_length():
    got = recall_by_length(invented([16, 17, 20, 24, *range(26, 60, 3)] * 3))
    assert min(got.values()) >= 0.95, got
    got = recall_by_length(invented([12, 13, 14, *range(40, 200, 10)]))
    assert min(got.values()) >= 0.95, got


def test_lengths_beyond_the_tables_are_searched_exactly(monkeypatch):
    monkeypatch.setattr(decontam, "MAX_TABLES", 0)
    got = recall_by_length(invented([8, 12, 30, 60, 150]))
    assert set(got.values()) == {1.0}


def test_short_items_leave_the_long_ones_their_tables():
    got = recall_by_length(invented([8, 40, 60]))
    assert min(got.values()) >= 0.95, got
    got = recall_by_length(invented([8, 9, 10, 11, 12, 40, 100]))
    assert min(got.values()) >= 0.95, got


def test_many_items_of_all_lengths():
    rng = random.Random(17)
    sizes = [3 + i % 58 for i in range(2000)]
    texts = invented(sizes)
    index = decontam.Index(list(range(2000)), texts)
    assert set(index.recall) == set(sizes) and min(index.recall.values()) >= 0.98
    spaces = [" ".join(f"f{rng.randrange(10**6)}" for _ in range(30)) for _ in texts]
    found = {(d, i) for d, (a, t) in enumerate(zip(spaces, texts)) for s in [decontam.sequences([a + " " + t + " " + a])[0]] for _, i, _, e in index.search(s, np.array([0, len(s)])) if e == 0}
    assert {(i, i) for i in range(2000)} <= found
    gen, hits = np.random.default_rng(5), {}
    for i in range(2000):
        words = decontam._edited(index.items[i], int(index.permitted[i]), gen)
        hits.setdefault(sizes[i], []).append(any(j == i for _, j, *_ in index.search(words, np.array([0, len(words)]))))
    assert np.mean([h for x in hits.values() for h in x]) >= 0.98 and min(np.mean(x) for x in hits.values()) >= 0.85


def test_index_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1)
    got = recall_by_length(invented([30, 60, 150]))
    assert min(got.values()) >= 0.95, got


def test_very_long_item_and_text():
    long = invented([4000])[0]
    index = decontam.Index([0, 1], [long, "one short item of six words"])
    text = decontam.sequences([" ".join(invented([9000])) + " x " + long + " one short item of six words " + " ".join(invented([9000]))])[0]
    assert [(i, e) for _, i, _, e in index.search(text, np.array([0, len(text)]))] == [(0, 0), (1, 0)]


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame([(i, "before " + t + " after") for i, t in items], "doc_id bigint, text string")
    whole = sorted(decontam.matches(df, benchmark).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert sorted(decontam.matches(df, benchmark).collect()) == whole and len(whole) == 12


def test_items_of_few_words_inside_documents(spark):
    items = ["who wrote this old play", "which river crosses the grey city", "yes", "blue cheese"]
    texts = ["a b who wrote this old play c d", "a b who penned this old play c", "x which river crosses a grey city", "which river crosses grey city", "a yes b", "Yes!", "some blue cheese", "Blue cheese", "who wrote that new play", "blue or cheese"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontam.matches(df, benchmark).collect()}
    assert got == {(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 1), (4, 2, 0), (5, 2, 0), (6, 3, 0), (7, 3, 0)}
    # items of fewer than MIN_WORDS words drop only documents that consist of them
    assert {r.doc_id for r in decontam.clean(df, benchmark).collect()} == {4, 6, 8, 9}


def test_edges(spark, docs, no_docs):
    benchmark = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (None, "short"), (2, None), (3, ""), (4, "!!!"), (1, "The quick brown fox jumps over the lazy dog")], "item_id bigint, text string")
    got = decontam.matches(docs, benchmark).collect()
    assert {r.doc_id for r in got} == {1, 2, 7}
    out = decontam.clean(docs, benchmark)
    assert out.columns == docs.columns and out.count() == docs.count() - 4
    assert decontam.matches(no_docs, benchmark).count() == 0 and decontam.clean(no_docs, benchmark).count() == 0
    assert decontam.matches(docs, benchmark.where("false")).count() == 0 and decontam.clean(docs, benchmark.where("false")).count() == docs.count()
