import hashlib
import re

from tallyloom.llm import fingerprints

LEAF = re.compile(r"[^.!?|]{1,80}[.!?|]*|[.!?|]+")


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def tree(text):
    """(root, fingerprint, leaves) by plain Python."""
    out, leaves, nodes = "", set(), []
    for section in text.split("\n\n"):
        inner, hashes = [], []
        for paragraph in section.split("\n"):
            own = [md5(x) for x in LEAF.findall(paragraph)]
            leaves |= {x[:16] for x in own}
            hashes.append(md5("".join(own)))
            inner.append(f"{hashes[-1][:8]}:{','.join(x[:16] for x in own)}")
        nodes.append(md5("".join(hashes)))
        out += f"{nodes[-1][:8]}{{{';'.join(inner)}}}"
    root = hashlib.sha256("".join(nodes).encode()).hexdigest()
    return root, f"{root}|{out}", leaves


def like(a, b):
    return 1.0 if a[0] == b[0] else 0.0 if not a[2] and not b[2] else 2 * len(a[2] & b[2]) / (len(a[2]) + len(b[2]))


def test_against_python(spark):
    texts = ["One. Two! Three?\nFour.\n\nFive | six", "One. Two! Three?\nFour.\n\nFive | seven", "", "x" * 500, "One. Two! Three?\nFour.\n\nFive | six", "é🙂. à\n\n\n"]
    texts = [(t * (1 + i % 3)) for i, t in enumerate(texts * 20)]
    rows = [(i * 3 - 7, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        a, e, b = tree(t), tree(edited), tree(n)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a[1], e[1])
        assert abs(r.near_edited - like(a, e)) < 1e-12 and abs(r.near_next - like(a, b)) < 1e-12


def test_edges(docs, no_docs):
    got = fingerprints.edited_likeness(docs).collect()
    assert len(got) == docs.count()
    empty = {r.fingerprint for r in got if r.n_chars == 0}
    assert empty == {tree("")[1]}
    assert fingerprints.edited_likeness(no_docs).count() == 0
    alone = fingerprints.edited_likeness(docs.where("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    marked = fingerprints.fingerprints(docs.drop("root"))
    assert {"root", "fingerprint"} < set(marked.columns) and marked.count() == docs.count()
    # names that are taken
    both = fingerprints.fingerprints(docs)
    assert both.columns == [*docs.columns, "_root", "fingerprint"] and {r.root for r in both.collect()} == {"x"}


def lacking(a, b):
    """(side, section, paragraph, leaf, text) by plain Python: parts of a branch that the other text's branches of that level lack."""
    node = lambda p: md5("".join(md5(x) for x in LEAF.findall(p)))
    whole = lambda s: md5("".join(node(p) for p in s.split("\n")))

    def apart(parts, key):
        have = {k: {key(v[-1]) for v in vs} for k, vs in parts.items()}
        return {k: [v for v in vs if key(v[-1]) not in have["ba"[k == "b"]]] for k, vs in parts.items()}

    parts = apart({k: list(enumerate(t.split("\n\n"))) for k, t in (("a", a), ("b", b))}, whole)
    parts = apart({k: [(i, j, p) for i, s in v for j, p in enumerate(s.split("\n"))] for k, v in parts.items()}, node)
    parts = apart({k: [(i, j, n, x) for i, j, p in v for n, x in enumerate(LEAF.findall(p))] for k, v in parts.items()}, str)
    return {(k, *v) for k, vs in parts.items() for v in vs}


def test_diff_locates_edits(spark):
    from pyspark.sql import functions as F

    text = "First one. And two.\nA paragraph.\n\nSecond section. With more.\nLast words here."
    pairs = [(1, text, text.replace("two", "three")), (2, text, text), (3, text, "Intro.\n\n" + text), (4, text, None), (5, None, ""), (6, text, text.replace("A paragraph.\n", "")), (7, "x. " * 90_000 + "end.", "x. " * 90_000 + "fin."), (None, "a. b", "a. c")]
    df = spark.createDataFrame(pairs + pairs[:1], "doc_id bigint, old string, new string").withColumn("row", F.lit(1))
    got = {tuple(r) for r in fingerprints.diff(df, F.col("old"), F.col("new")).collect()}
    assert got == {(i, *x) for i, a, b in pairs for x in lacking(a or "", b or "")}
    assert {x for x in got if x[0] == 1} == {(1, "a", 0, 0, 1, " And two."), (1, "b", 0, 0, 1, " And three.")}
    assert {x[1:] for x in got if x[0] == 3} == {("b", 0, 0, 0, "Intro.")}
    assert fingerprints.diff(df.where("false"), F.col("old"), F.col("new")).count() == 0
