import random
import re
from collections import Counter

import numpy as np
import pytest
from tallyloom.llm import neardup
from tallyloom.llm.shared import components


def shingles(text):
    """Multiset of shingles of five words, by plain Python; a shorter text is one shingle."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words)


def similarity(a, b):
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least) if a or b else 1.0


def classes_by_brute_force(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    size = [sum(s.values()) for s in sets]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and min(size[i], size[j]) >= threshold * max(size[i], size[j]) and similarity(sets[i], sets[j]) >= threshold:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}


def varied(words, share, rng):
    return [f"z{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        for c in range(rng.randrange(1, 9)):
            rows.append((len(rows), " ".join(varied(base, rng.choice([0, 0.003, 0.01, 0.02, 0.04]), rng))))
    base = [f"h{rng.randrange(3000)}" for _ in range(150)]
    for _ in range(250):  # one large group, many of whose pairs are below the threshold
        rows.append((len(rows), " ".join(varied(base, rng.choice([0.005, 0.01, 0.02, 0.03, 0.05]), rng))))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", "  ", "one two", "ONE, two", "two one", "a a a a a a a a", "a a a a a a a a a"])]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {r.doc_id: r.class_id for r in found}
    groups = Counter(got.values())
    texts = {i: shingles(t) for i, t in rows}
    for r in found:
        alone = all(texts[i] == texts[r.doc_id] for i, c in got.items() if c == r.class_id) if groups[r.class_id] > 1 else True
        assert (r.n_links == 0) == (r.similarity is None) == alone
        if not alone and r.doc_id < 60:
            assert any(abs(similarity(texts[r.doc_id], texts[i]) - r.similarity) < 1e-6 for i in got if i != r.doc_id)
    want = classes_by_brute_force(rows)
    wrong = sum(got[i] != want[i] for i in want)
    assert len(got) == len(rows) and wrong <= 0.01 * len(rows), wrong


@pytest.mark.parametrize("heavy", [1, 40])
def test_signatures_are_unbiased(heavy):
    rng = np.random.default_rng(heavy)
    shingle = np.sort(rng.integers(1, 1 << 62, 200).astype(np.uint64))
    errors = []
    for _ in range(12):
        a, b = (rng.integers(0, 1 + heavy, 200) for _ in range(2))
        b = np.where(rng.random(200) < 0.7, a, b)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        sig = [neardup.signatures(np.zeros((w > 0).sum(), int), shingle[w > 0], w[w > 0], 1, 2048)[0] for w in (a, b)]
        errors.append((sig[0] == sig[1]).mean() - want)
    assert abs(np.mean(errors)) < 0.012 and np.abs(errors).max() < 0.06


def test_bound_holds():
    """What two texts share is never above the bound by their differences from a leader."""
    rng = random.Random(4)
    count = lambda m: np.unpackbits(np.array(m, np.int64).view(np.uint8)).astype(bool)
    base = [f"w{rng.randrange(40)}" for _ in range(120)]
    for _ in range(200):
        leader, x, y = (neardup._multiset(" ".join(varied(base, rng.choice([0, 0.02, 0.1]), rng))) for _ in range(3))
        shared = lambda a, b: sum(min(int(n), dict(zip(b[0].tolist(), b[1].tolist(), strict=True)).get(s, 0)) for s, n in zip(a[0].tolist(), a[1].tolist(), strict=True))
        miss = [count(neardup._bitmap(neardup._excess(leader, s)[0])) for s in (x, y)]
        extra = [count(neardup._bitmap(neardup._excess(s, leader)[0])) for s in (x, y)]
        more = [neardup._excess(s, leader)[1] for s in (x, y)]
        bound = int(leader[1].sum()) - (miss[0] | miss[1]).sum() + min(more[0] - (extra[0] & ~extra[1]).sum(), more[1] - (extra[1] & ~extra[0]).sum())
        assert shared(x, y) <= bound


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 300), (7, 7)]
    df = spark.createDataFrame([(bytes([0, a // 256, a % 256]), bytes([0, b // 256, b % 256])) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(bytes(r.node)): int.from_bytes(bytes(r.label)) for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), 200: 200, 300: 200}
    assert components(df.where("false")).count() == 0


def test_ties_of_repeated_rows(spark):
    rows = [(1, "one text of six words here", "b"), (1, "one text of six words here", "a"), (1, "one text of six words here", None), (2, "another text of six other words", "z")]
    out = neardup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, other string")).collect()
    assert sorted(map(tuple, out)) == [rows[1], rows[3]]


def test_edges(docs, no_docs):
    got = neardup.classes(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[8] == 8
    assert sorted((r.class_id for r in got if r.doc_id is None), key=str) == [3, None]
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 3, 6, 7, 8, None], key=str)
    assert neardup.classes(no_docs).count() == 0 and neardup.keep_one(no_docs).count() == 0
