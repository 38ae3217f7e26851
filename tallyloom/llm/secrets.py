"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Base kinds are found in the whole text, leftmost and non-overlapping for each kind:

* ``assign``: a keyword, ``:`` or ``=``, and a value of 8 or more characters (shorter ones consume their text and go);
* ``access``: ``AKIA`` and capitals or digits, 16 or more characters in all;
* ``hex``: a run of 32 or more of ``0-9a-f``.

The method adds kind ``wide``: provider-prefixed tokens, private-key headers, capital hex runs, and runs of 40 or
more token characters with lower case, capitals and digits, none of which overlaps a base span.  The value of each
candidate is hashed, and the hashes are counted over the whole corpus by distinct repositories and owners.
A value of ``min_owners`` owners or more, or of ``min_repos`` repositories or more (of however few owners), is a widely copied
example; a rarer one is owner-specific and, with 16 or more characters including digits and letters, live-looking.  Only ``wide``
spans that are live-looking are added.

``redact`` replaces live-looking owner-specific values; with ``any_shape`` also those of base kinds whatever their shape, but for
obvious placeholders: one character over and over, or nothing but runs of four or more successive letters or digits (``abcdefgh12345``).

Counting is map-side combined (a value that a third of all rows hold becomes one row per task), and the join back is
a sort-merge join whose skewed partitions are split at run time.  ``scan`` never shuffles texts; ``redact`` joins whole rows to the
spans of those that have any, and where that list is above Spark's threshold of broadcasts, texts are exchanged once.

Nulls and edges: a null text is empty; very long texts are read whole, and a text's spans take time in proportion to their number (but for a factor of
``RUN``); extra columns, whatever their names, are kept by ``redact`` and left out by ``scan``; spans that start together are in the order of kinds; a null owner or repository counts as no owner or repository of its own (a value seen only
there has 0); repeated rows give repeated result rows with the same spans; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import free_names, written

_KEY = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run is maximal, so the least length can stand in the pattern
HEX = "[0-9a-f]{32,}"
WIDE = (
    "(?:gh[opusr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}"
    "|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{17,}[.]eyJ[A-Za-z0-9_-]{10,}(?:[.][A-Za-z0-9_-]+)?|-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----|[0-9A-F]{32,}|[A-Za-z0-9+/_-]{40,}={0,2})"
)
KINDS = ("assign", "access", "hex", "wide")
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
#: Matches whose places are found together.
RUN = 128


def _spans(text: Column, pattern: str, kind: int, maybe: Column, group: int = 0) -> Column:
    """Matches as structs (start, kind, end, value); start and end count code points.

    Spark returns matched strings without their places; the pieces between them, from split() by the same pattern,
    give these.  Both run only where ``maybe``, a cheap necessary condition, holds.
    """
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("p"), whole.alias("w"), value.alias("v"))
    none = F.array().cast(SPAN)

    def step(acc: Column, m: Column) -> Column:
        s = acc["at"] + F.length(m["p"])
        e = s + F.length(m["w"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), m["v"].alias("v")))).cast(SPAN).alias("out"))

    def runs(f: Column) -> Column:
        """Places by runs of ``RUN`` matches, since appending to an array copies it; then the runs one after another."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(f, i * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        moved = lambda x, by: F.struct((x["s"] + by).alias("s"), x["k"].alias("k"), (x["e"] + by).alias("e"), x["v"].alias("v"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        after = lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(c["out"], lambda x: moved(x, acc["at"])))).cast(f"array<{SPAN}>").alias("out"))
        return F.when(F.size(f) > 0, F.flatten(F.aggregate(parts, start, after)["out"])).otherwise(none)

    # as an element of an array the matches are taken once, however often they are referred to
    return F.when(maybe, F.transform(F.array(found), runs)[0]).otherwise(none)


#: Runs of four or more successive letters or digits.
_RUNS = "(?:" + "|".join(r[a : a + n] for r in ("abcdefghijklmnopqrstuvwxyz", "01234567890") for n in range(len(r), 3, -1) for a in range(len(r) - n + 1)) + ")+"
PLACEHOLDER = rf"^(?:(.)\1*|{_RUNS})$"


def candidates(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    keyword = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & (
        F.contains(low, F.lit("passw")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("api"))
    )
    long_run = text.rlike("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}") | F.contains(text, F.lit("PRIVATE KEY-----"))
    base = {
        "assign": F.filter(_spans(text, ASSIGN, 0, keyword & text.rlike(ASSIGN), 2), lambda x: F.length(x["v"]) >= 8),
        "access": _spans(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))),
        "hex": _spans(text, HEX, 2, text.rlike(HEX)),
    }
    return base | {"wide": _spans(text, WIDE, 3, long_run)}


def _print(spans: Column) -> Column:
    """kind:start:end, by start and then kind."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def candidate_table(docs: DataFrame, *, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """One narrow row per row of ``docs``: its id, a hash of its text (only where it has candidates), base and wide spans.  Written, since
    it is read twice and the regular expressions are the costly part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), text.alias("t"))
    found = found.select("*", *[c.alias(k) for k, c in candidates(F.col("t")).items()])
    base = F.concat("assign", "access", "hex")
    mixed = lambda v: (v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")) | v.rlike("^[0-9A-F]{32,}$") | F.contains(v, F.lit("PRIVATE KEY-----"))
    apart = F.filter("wide", lambda x: mixed(x["v"]) & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    out = found.withColumn("base", base).withColumn("extra", apart)
    return written(
        out.select(
            "doc_id", F.when(F.size("base") + F.size("extra") > 0, F.xxhash64("t")).alias("text_key"), "repo", "owner",
            *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], "base", "extra",
        ),
        "secrets",
    )


def judged(table: DataFrame, min_owners: int = 3, min_repos: int = 100) -> DataFrame:
    """One row per candidate span: doc_id, text_key, span, and ``live`` or not, and ``secret`` (to be redacted) or not, by the corpus-wide counts of its hash."""
    each = table.where(F.col("text_key").isNotNull()).select("doc_id", "text_key", "repo", "owner", F.explode(F.concat("base", "extra")).alias("x"))
    each = each.withColumn("h", F.md5("x.v"))
    counts = each.groupBy("h").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    looks = (F.length("x.v") >= 16) & F.col("x.v").rlike("[0-9]") & F.col("x.v").rlike("[A-Za-z]") | F.contains("x.v", F.lit("PRIVATE KEY-----"))
    secret = F.when(F.col("x.k") == 3, looks).otherwise(~F.lower("x.v").rlike(PLACEHOLDER))
    example = (F.col("n_owners") >= min_owners) | (F.col("n_repos") >= min_repos)
    return each.join(counts, "h").select("doc_id", "text_key", "x", "n_repos", "n_owners", example.alias("example"), (~example & looks).alias("live"), (~example & secret).alias("secret"))


def per_text(spans: DataFrame) -> DataFrame:
    """Judged spans gathered by text; repeated rows' spans fall together."""
    return spans.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(F.col("live") & (F.col("x.k") == 3), F.col("x"))).alias("added"),
        F.collect_set(F.when(F.col("live"), F.struct((F.col("x.e") - F.length("x.v")).alias("s"), F.col("x.e").alias("e")))).alias("live"),
        F.collect_set(F.when(F.col("secret"), F.struct((F.col("x.e") - F.length("x.v")).alias("s"), F.col("x.e").alias("e")))).alias("secret"),
        F.size(F.collect_set(F.when(F.col("example"), F.col("x")))).cast("long").alias("n_example"),
        F.max("n_repos").alias("most_repos"),
        F.max("n_owners").alias("most_owners"),
    )


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, min_owners: int = 3, min_repos: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, and of its values' repositories and owners the
    most that one has.

    ``repo`` and ``owner`` say where a document comes from; by default each document is a repository and its ``source`` the owner.
    """
    table = candidate_table(docs, id_col=id_col, text_col=text_col, repo=F.col(id_col) if repo is None else repo, owner=F.col("source") if owner is None else owner)
    marks = per_text(judged(table, min_owners, min_repos)).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    out = table.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:3]], F.sha2(_print(F.col("base")), 256).alias("base_sha256"), _print(F.concat("base", F.coalesce("added", F.array().cast(SPAN)))).alias("spans"),
        F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("most_repos", "most_owners")],
    )


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, min_owners: int = 3, min_repos: int = 100, mark: str = "[SECRET]", any_shape: bool = False) -> DataFrame:
    """``docs`` with the values of live-looking (with ``any_shape`` all) owner-specific credentials replaced by ``mark``; widely copied examples stay.

    Only texts with a live value are joined to their spans; Spark broadcasts that table if it is under its threshold.
    """
    table = candidate_table(docs, id_col=id_col, text_col=text_col, repo=F.col(id_col) if repo is None else repo, owner=F.col("source") if owner is None else owner)
    of, key, live = free_names(docs, "_id", "_key", "_live")
    which = "secret" if any_shape else "live"
    marks = written(per_text(judged(table, min_owners, min_repos)).where(F.size(which) > 0).select(F.col("doc_id").alias(of), F.col("text_key").alias(key), F.array_sort(which).alias(live)), "secrets-live")
    text = F.col(f"`{text_col}`")
    hit = docs.join(marks, F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(key)), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out")))

    new = F.aggregate(live, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return hit.select(*[(F.when(F.col(live).isNotNull(), new).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_spans(kind: int, group: int = 0) -> str:
    """List of structs of the matches of kind number ``kind``, of columns p, w and v with its number."""
    before = f"coalesce(list_sum(list_transform(p{kind}[1:i], lambda z: len(z))), 0) + coalesce(list_sum(list_transform(w{kind}[1:i - 1], lambda z: len(z))), 0)"
    value = f"v{kind}[i]" if group else f"w{kind}[i]"
    return f"list_transform(w{kind}, lambda w, i: {{'s': ({before})::INT, 'k': {kind}, 'e': ({before} + len(w))::INT, 'v': {value}}})"


def _sql_text(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda x: ['assign', 'access', 'hex', 'wide'][x.k + 1] || ':' || x.s || ':' || x.e), ','), '')"


_PATTERNS = [p.replace("'", "''") for p in (ASSIGN, ACCESS, HEX, WIDE)]
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
m AS (SELECT doc_id, source, rid, {", ".join(f"string_split_regex(t, '{p}') AS p{k}, regexp_extract_all(t, '{p}') AS w{k}" for k, p in enumerate(_PATTERNS))}, regexp_extract_all(t, '{_PATTERNS[0]}', 2) AS v0 FROM d),
f AS (SELECT doc_id, source, rid, list_filter({_sql_spans(0, 2)}, lambda x: len(x.v) >= 8) AS a, {_sql_spans(1)} AS b, {_sql_spans(2)} AS c, {_sql_spans(3)} AS wide FROM m),
g AS (SELECT *, list_concat(list_concat(a, b), c) AS base FROM f),
h AS (SELECT *, list_filter(wide, lambda x: ((regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[A-Z]')) OR regexp_matches(x.v, '^[0-9A-F]{{32,}}$') OR contains(x.v, 'PRIVATE KEY-----'))
  AND len(list_filter(base, lambda y: y.s < x.e AND x.s < y.e)) = 0) AS extra FROM g),
e AS (SELECT rid, doc_id, source, unnest(list_concat(base, extra)) AS x FROM h),
n AS (SELECT md5(x.v) AS key, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos FROM e GROUP BY 1),
j AS (SELECT rid, x, owners, repos, owners >= 3 OR repos >= 100 AS example, owners < 3 AND repos < 100 AND (len(x.v) >= 16 AND regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[A-Za-z]') OR contains(x.v, 'PRIVATE KEY-----')) AS live FROM e JOIN n ON n.key = md5(e.x.v)),
t AS (SELECT rid, list(x) FILTER (live AND x.k = 3) AS added, (count(DISTINCT (x.e - len(x.v), x.e)) FILTER (live))::BIGINT AS n_live, (count(DISTINCT x) FILTER (example))::BIGINT AS n_example, max(repos)::BIGINT AS most_repos, max(owners)::BIGINT AS most_owners FROM j GROUP BY 1)
SELECT doc_id, len(a)::BIGINT AS n_assign, len(b)::BIGINT AS n_access, len(c)::BIGINT AS n_hex, sha256({_sql_text("base")}) AS base_sha256, {_sql_text("list_concat(base, coalesce(added, []))")} AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example, coalesce(most_repos, 0)::BIGINT AS most_repos, coalesce(most_owners, 0)::BIGINT AS most_owners FROM h LEFT JOIN t USING (rid)
"""
