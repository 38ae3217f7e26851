import hashlib
import random
import re
import string

from tallyloom.llm import secrets

PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def base(text):
    out = []
    for n, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[group]) >= least:
                out.append((m.start(), n, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def random_texts(n):
    rng = random.Random(3)
    parts = ["password = ", "ToKen:", "api_key=\"", "APIKEY : '", "secret=", "AKIA", "x", " ", "\n", "é🙂", "ſecret=", "passwd='", "hello world "]
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(1, 25)):
            out.append(rng.choice(parts))
            out.append("".join(rng.choice(rng.choice([string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits])) for _ in range(rng.choice([0, 3, 7, 8, 12, 16, 33, 45]))))
        yield "".join(out)


def test_base_spans_by_python(spark):
    texts = list(random_texts(400))
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame([(i, t, f"s{i % 4}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in PATTERNS)
        assert set(want) <= set(got[i].spans.split(",")) if want else True


def test_ownership(spark):
    copied, own = "ghp_" + "a1B2c3D4e5" * 4, "ghp_" + "Z9y8X7w6V5" * 4
    rows = [(i, f"use {copied} here", f"s{i}") for i in range(5)] + [(10, f"mine is {own} ok", "s0"), (11, f"again {own}", "s0")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert all(got[i].spans == "" and got[i].n_live == 0 and got[i].n_example == 1 for i in range(5))
    assert got[10].spans == f"wide:8:{8 + len(own)}" and got[10].n_live == 1
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[10] == "mine is [SECRET] ok" and clean[0] == rows[0][1]


def test_redaction_takes_base_values_of_any_shape(spark):
    key = "AKIA" + "QWERTZUIOPASDFGH"
    texts = {
        "the password: S3cretPw9 ok": "the password: [SECRET] ok",
        "token=correcthorsebatterystaple": "token=[SECRET]",
        "secret = 90210777123499": "secret = [SECRET]",
        f"use {key} now": "use [SECRET] now",
        f"hex {'deadbeef' * 3 + 'cafebabe'}.": "hex [SECRET].",
        "password=xxxxxxxxxxxx": "password=xxxxxxxxxxxx",
        "password=ABCDEFGH12345": "password=ABCDEFGH12345",
        "nothing " + "a-b" * 20: "nothing " + "a-b" * 20,
    }
    rows = [(i, t, "one") for i, t in enumerate(texts)] + [(100 + i, "password: changeme123", f"s{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.text for r in secrets.redact(df, any_shape=True).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    assert got[100] == "password: changeme123"


def test_edges(docs, no_docs):
    got = secrets.scan(docs).collect()
    assert len(got) == docs.count()
    none = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in got if r.doc_id in (3, 4, 5)} == {none}
    assert [r.n_assign for r in got if r.doc_id is None and r.spans] == [1]
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    # a value of 13 characters isn't live-looking, so that text stays; so do null ones
    assert {r.text for r in out.where("doc_id is null").collect()} == {None, "An unnamed text with password=abcdefgh12345 in it."}
    assert secrets.scan(no_docs).count() == 0 and secrets.redact(no_docs).count() == 0


def test_repositories_and_owners_decide(spark):
    many, few, some = "ghp_" + "a1B2c3D4e5" * 4, "ghp_" + "Z9y8X7w6V5" * 4, "ghp_" + "Q1w2E3r4T5" * 4
    rows = [(i, many, "s0") for i in range(120)] + [(200 + i, few, "s0") for i in range(40)] + [(300 + i, some, f"s{i}") for i in range(3)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert (got[0].n_live, got[0].n_example, got[0].most_repos, got[0].most_owners) == (0, 1, 120, 1)
    assert (got[200].n_live, got[200].n_example, got[200].most_repos, got[200].most_owners) == (1, 0, 40, 1)
    assert (got[300].n_live, got[300].n_example, got[300].most_repos, got[300].most_owners) == (0, 1, 3, 3)


def test_very_many_spans_in_one_text(spark):
    text = "\n".join("0123456789abcdef" * 2 + f"{i % 10}" for i in range(30_000))
    got = secrets.scan(spark.createDataFrame([(1, text, "a"), (2, text[:34 * 129], "a"), (3, text[:34 * 128], "b")], "doc_id bigint, text string, source string")).collect()
    for r, t in zip(sorted(got), (text, text[: 34 * 129], text[: 34 * 128]), strict=True):
        assert r.base_sha256 == hashlib.sha256(",".join(base(t)).encode()).hexdigest()
