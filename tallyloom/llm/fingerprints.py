"""Document fingerprints: a Merkle tree over sections and paragraphs, with DataFrame functions only.

A text is cut at blank lines into sections, a section at line ends into paragraphs, a paragraph into leaves:
sentences, or pieces of 80 characters of longer ones.  A leaf's node is the MD5 of its text, a paragraph's
that of its leaves' nodes, a section's that of its paragraphs' nodes, and the root is the SHA-256 of the
sections' nodes.  Equal texts have equal roots; where roots differ, the sections, paragraphs and leaves whose
nodes differ show where: ``diff`` walks down the trees of two texts, level by level, into those branches that the other text lacks.
The printed fingerprint has the root in full, the first 8 digits of sections and paragraphs and the first 16 of leaves (64 bits, so
that leaves of different texts hardly ever agree by chance): ``root|section{paragraph:leaf,leaf;paragraph:leaf}section{...}``.

The likeness of two fingerprints is the Dice coefficient of their sets of leaves, 1 for equal roots, and 0 if
just one has leaves or both have none and the roots differ.

Nulls and edges: a null text is the empty text (one section with one paragraph without leaves).  A null id sorts
first; rows of one id are ordered by their texts; the last row's next document is the first.  An only document
is its own next.  Very long texts are read whole.  An empty table gives an empty result.  Extra columns are left alone, whatever their
names: a new column whose name is taken has underscores in front.  ``with_next`` deals rows by ranges of ids, so the rows of one id (or
of no id) are in one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import free_names, written

LEAF = r"[^.!?|]{1,80}[.!?|]*|[.!?|]+"


def merkle(text: Column) -> Column:
    """struct(root, fingerprint, leaves) of a text."""
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), F.md5)
    node = lambda leaves: F.struct(F.md5(F.array_join(leaves, "")).alias("h"), F.transform(leaves, lambda x: F.substring(x, 1, 16)).alias("l"))
    tree = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.transform(F.split(s, "\n", -1), paragraph), node))
    sections = F.transform(tree, lambda s: F.struct(F.md5(F.array_join(F.transform(s, lambda p: p["h"]), "")).alias("h"), s.alias("p")))
    return F.transform(F.array(sections), _finish)[0]


def _finish(sections: Column) -> Column:
    root = F.sha2(F.array_join(F.transform(sections, lambda s: s["h"]), ""), 256)
    show = F.transform(
        sections, lambda s: F.concat(F.substring(s["h"], 1, 8), F.lit("{"), F.array_join(F.transform(s["p"], lambda p: F.concat(F.substring(p["h"], 1, 8), F.lit(":"), F.array_join(p["l"], ","))), ";"), F.lit("}"))
    )
    leaves = F.array_distinct(F.flatten(F.flatten(F.transform(sections, lambda s: F.transform(s["p"], lambda p: p["l"])))))
    return F.struct(root.alias("root"), F.concat(root, F.lit("|"), F.array_join(show, "")).alias("fingerprint"), leaves.alias("leaves"))


def likeness(a: Column, b: Column) -> Column:
    """Of two merkle() structs."""
    total = F.size(a["leaves"]) + F.size(b["leaves"])
    return F.when(a["root"] == b["root"], 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a["leaves"], b["leaves"])) / total)


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``root`` and ``fingerprint``, in place: no shuffle."""
    root, fingerprint, m = free_names(docs, "root", "fingerprint", "_m")
    out = docs.withColumn(m, merkle(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{m}.root").alias(root), F.col(f"{m}.fingerprint").alias(fingerprint))


def diff(docs: DataFrame, a: Column, b: Column, *, id_col: str = "doc_id") -> DataFrame:
    """Where the texts ``a`` and ``b`` of each row differ: doc_id, side (a or b), section, paragraph and leaf (from 0), and text, of all leaves that the other text lacks in what its branch is compared with.

    Rows of equal roots end at once.  Of the rest, sections whose node the other text lacks are opened, of these the paragraphs whose node it lacks, and
    of these the leaves; each level is an anti-join by row and node, so no two parts are compared pairwise.  Rows of one id and equal texts are one.
    A paragraph that only moved, or has no leaf of its own (only leaves that the other has elsewhere in opened paragraphs), gives no row.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text(a).alias("a"), text(b).alias("b")).where("a != b")
    rows = rows.withColumn("row", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("a"), F.md5("b")), 256)).select("doc_id", "row", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("t")) for s in "ab"])).alias("x"))

    def lacked(level: DataFrame) -> DataFrame:
        """Of nodes with column h those whose node isn't on the other side."""
        other = level.select(F.col("row").alias("_row"), F.when(F.col("side") == "a", "b").otherwise("a").alias("_side"), F.col("h").alias("_h")).distinct()
        return level.join(other, (F.col("row") == F.col("_row")) & (F.col("side") == F.col("_side")) & (F.col("h") == F.col("_h")), "left_anti")

    leaves = lambda p: F.regexp_extract_all(p, F.lit(LEAF), F.lit(0))
    node = lambda p: F.md5(F.array_join(F.transform(leaves(p), F.md5), ""))
    sections = rows.select("doc_id", "row", "x.side", F.posexplode(F.split("x.t", "\n\n", -1)).alias("section", "t"))
    sections = written(lacked(sections.withColumn("h", F.md5(F.array_join(F.transform(F.split("t", "\n", -1), node), "")))), "diff-sections")
    paragraphs = sections.select("doc_id", "row", "side", "section", F.posexplode(F.split("t", "\n", -1)).alias("paragraph", "t"))
    paragraphs = written(lacked(paragraphs.withColumn("h", node(F.col("t")))), "diff-paragraphs")
    found = paragraphs.select("doc_id", "row", "side", "section", "paragraph", F.posexplode(leaves(F.col("t"))).alias("leaf", "text"))
    return lacked(found.withColumn("h", F.md5("text"))).select("doc_id", "side", *[F.col(c).cast("long").alias(c) for c in ("section", "paragraph", "leaf")], "text").distinct()


def with_next(rows: DataFrame, key: str, carry: list[str], tie: str) -> DataFrame:
    """Adds ``next_<c>`` for each column of ``carry``: its value in the row that follows by ``key`` (a long).

    A global window would put all rows into one task.  Here a scan of the keys alone finds ranges of about as
    many rows each (approximate quantiles, merged from a bounded sketch per task); every row goes to its range in one exchange, the first rows of a range also to the range
    before (the first of all to the last range), and lead() runs within ranges.  The ranges' lower ends are the
    only thing on the driver: a few longs for each shuffle partition.
    """
    spark = rows.sparkSession
    at = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    n = max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = rows.select(at.alias("k")).agg(F.min("k").alias("low"), F.percentile_approx("k", [i / n for i in range(1, n)], 8 * n).alias("q")).first()
    lows = sorted({got.low, *got.q}) if got.q else []
    if not lows:
        lows = [0]
    ends, steps = F.from_json(F.lit(json.dumps(lows)), "array<bigint>"), max(1, len(lows).bit_length())
    #: binary search for the last lower end that is not above the key
    jumps = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    index = F.aggregate(jumps, F.lit(0), lambda lo, j: F.when((lo + j < len(lows)) & (F.element_at(ends, F.least(lo + j, F.lit(len(lows) - 1)) + 1) <= at), lo + j).otherwise(lo))
    placed = rows.withColumn("_at", at).withColumn("_b", index)
    first = F.col("_at") == F.element_at(ends, F.col("_b") + 1)
    before = (F.col("_b") + len(lows) - 1) % len(lows)
    home = F.struct(F.col("_b").alias("b"), F.lit(0).alias("s"))
    placed = placed.withColumn("_p", F.explode(F.when(first, F.array(home, F.struct(before.alias("b"), F.lit(1).alias("s")))).otherwise(F.array(home))))
    w = Window.partitionBy("_p.b").orderBy("_p.s", "_at", tie)
    out = placed.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return out.where("_p.s = 0").drop("_p", "_b", "_at")


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the next document's start, and how alike
    they are.  One exchange of the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    near = with_next(rows, "doc_id", ["text"], "text").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = near.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    # trees are made after the exchange: hashes don't compress, and making them again costs less than moving them
    e = edited.select("doc_id", "n_chars", merkle(F.col("text")).alias("m"), merkle(F.col("next_text")).alias("next_m"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), merkle(F.col("edited")).alias("e"))
    return e.select(
        "doc_id", "n_chars", "edited_sha256", F.col("m.fingerprint").alias("fingerprint"), F.col("e.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("m"), F.col("e")).alias("near_edited"), likeness(F.col("m"), F.col("next_m")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_TREE = r"""list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
  lambda p: list_transform(regexp_extract_all(p, '[^.!?|]{{1,80}}[.!?|]*|[.!?|]+'), lambda x: md5(x))))"""
_NODES = "list_transform({0}, lambda s: list_transform(s, lambda p: md5(array_to_string(p, ''))))"
_PRINT = """sha256(array_to_string(list_transform({1}, lambda s: md5(array_to_string(s, ''))), '')) || '|' || array_to_string(list_transform({0},
  lambda s, i: substr(md5(array_to_string({1}[i], '')), 1, 8) || '{{' || array_to_string(list_transform(s,
  lambda p, j: substr({1}[i][j], 1, 8) || ':' || array_to_string(list_transform(p, lambda x: substr(x, 1, 16)), ',')), ';') || '}}'), '')"""
_LEAVES = "list_distinct(list_transform(flatten(flatten({0})), lambda x: substr(x, 1, 16)))"
_LIKE = """CASE WHEN split_part({0}, '|', 1) = split_part({1}, '|', 1) THEN 1.0::DOUBLE WHEN len({2}) + len({3}) = 0 THEN 0.0::DOUBLE
  ELSE 2.0::DOUBLE * len(list_intersect({2}, {3})) / (len({2}) + len({3})) END"""
ORACLE = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
b AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nxt FROM a WINDOW o AS (ORDER BY doc_id ASC NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(nxt, 1, n_chars // 2) AS edited FROM b),
d AS (SELECT *, {_TREE.format("text")} AS t, {_TREE.format("edited")} AS te, {_TREE.format("nxt")} AS tn FROM c),
e AS (SELECT *, {_NODES.format("t")} AS h, {_NODES.format("te")} AS he, {_NODES.format("tn")} AS hn FROM d),
f AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_PRINT.format("t", "h")} AS fingerprint, {_PRINT.format("te", "he")} AS edited_fingerprint, {_PRINT.format("tn", "hn")} AS nf,
  {_LEAVES.format("t")} AS l, {_LEAVES.format("te")} AS le, {_LEAVES.format("tn")} AS ln FROM e)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_LIKE.format("fingerprint", "edited_fingerprint", "l", "le")} AS near_edited,
  {_LIKE.format("fingerprint", "nf", "l", "ln")} AS near_next FROM f
"""
