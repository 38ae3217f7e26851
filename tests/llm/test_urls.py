import random

from tallyloom.llm import urls

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:stop]


def rule(host, path):
    fits = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=lambda r: (len(r.split("/", 1)[0]), len(r)), default=None)


def table(spark, n=3000):
    rng = random.Random(7)
    hosts = [f"{rng.choice(['', 'www.', 'm.'])}site{i}.{rng.choice(['example.com', 'example.net', 'x.org', 'net', 'org', 'info'])}" for i in range(900)]
    urls_ = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice([str.upper, str])(rng.choice(hosts))}{rng.choice(['/de/', '/fr/1', '/en/a?x=://b', '', '?q#f', '#f', '/de', '/EN/'])}" for _ in range(n)]
    urls_ += [None, "", "no scheme", "://", ":///path", "http://İ.com/a", "http://a\nb/c"]
    return urls_, spark.createDataFrame([(i if i % 50 else None, u) for i, u in enumerate(urls_)], "page_id bigint, url string")


def test_against_python(spark):
    all_urls, pages = table(spark)
    listed = {h for i, h in enumerate(sorted({parts(u)[0] for u in all_urls} - {""})) if i % 4 == 0}
    df = spark.createDataFrame([(h,) for h in listed] + [("never.seen",)], "host string")
    for block_bits in (urls.BLOCK_BITS, 900):  # one block, and several
        got = urls.judge(pages, df, block_bits=block_bits).collect()
        assert len(got) == len(all_urls)
        want = []
        for i, u in enumerate(all_urls):
            host, path = parts(u)
            r = rule(host, path)
            want.append((i if i % 50 else None, host, path, r, RULES[r] if r else "block" if host in listed else "allow", host in listed))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_cascade_has_levels_and_is_exact(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS key", "id % 3 = 0 AS listed")
    cascade = urls.build(keys, 6667, 13333)
    rows = keys.toPandas()
    assert (cascade.listed(rows["key"].to_numpy()) == rows["listed"].to_numpy()).all()
    assert len(cascade.levels) > 2
    assert sum(len(b) * 8 for b, _, _ in cascade.levels) < urls.KEY_BITS * 6667


def test_edges(spark):
    from pyspark.sql import functions as F

    _, pages = table(spark, 20)
    none = spark.createDataFrame([], "host string")
    extra = pages.select("*", *[F.lit("x").alias(c) for c in ("host", "path", "_key", "listed", "rule", "verdict", "key")])
    assert urls.judge(extra, none).columns == ["page_id", "host", "path", "rule", "verdict", "listed"]
    assert not urls.judge(extra, none).where("listed").count()
    assert urls.judge(extra.where("false"), none).count() == 0
    twice = pages.union(pages)
    assert urls.judge(twice, urls.stand_in_list(twice)).count() == 2 * pages.count()


def test_the_list_decides_only_where_no_rule_does(spark):
    import hashlib

    all_urls, pages = table(spark)
    got = urls.judge(pages, urls.stand_in_list(pages)).collect()
    for r in got:
        assert r.listed == (r.host != "" and hashlib.sha256(r.host.encode()).hexdigest()[0] in "01")
        assert r.verdict == (RULES[r.rule] if r.rule else "block" if r.listed else "allow")
    assert any(r.listed and r.rule is None for r in got) and any(r.listed and r.verdict == "allow" for r in got)
    assert any(not r.listed and r.host.endswith("example.com") and r.verdict == "allow" for r in got)


def test_very_long_urls_and_ties_of_rules(spark):
    long = "http://a.example.com/" + "x" * 300_000
    df = spark.createDataFrame([(1, long + "?q"), (1, long + "?q"), (2, "http://one.two/de/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string")
    got = sorted(tuple(r) for r in urls.judge(df, none, rules=(("block", "one.two", "/de/"), ("allow", "one.two", "/de/"))).collect())
    assert [g[4] for g in got] == ["allow"] * 3 and len(got[0][2]) == 300_001
