"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k draw.

A document is the set of its hashed word unigrams and bigrams, words and runs of punctuation being tokens, lower case; n-grams that repeat one, two or
three tokens over and over are one symbol for each period and length. Two multinomial models over ``2 * BUCKETS`` buckets generate such sets: ``raw``, the
counts of all documents, and ``target``, those of the documents labelled good and not toxic. A document's log weight is log p_target - log p_raw, the sum
over its buckets of log((target's count + 1) / (the count that the raw model makes expected in the target's labelled text + 1)).

The models count as alike in all buckets but those that show what target text lacks, so that the many words of a long text don't add up to a verdict:

* the labelled documents that aren't target have the bucket ``DISTINCT`` times or more, and for their size ``TELLS`` times as often as the target's, which
  have it by ``SIGNIFICANT`` standard deviations less often than if both were alike;
* the target has it by a factor of ``TELLS`` less often than raw text, and by ``SIGNIFICANT`` standard deviations.

None counts for more than a factor of ``MOST``, so that one n-gram alone leaves a chance. Among the labelled documents a group
of copies counts once: each counts for one over the number of those of its label that share its least hash of ``RUN`` tokens. So copies neither add
evidence nor take any away.

``k`` documents are drawn without replacement in proportion to their weights: those with the largest log weight plus ``temperature`` (1) times a Gumbel
number from the hash of seed and id, by an exact search for the k-th largest key. Without a given ``k`` it is the sum of min(1, p_target / p_raw), the
number that rejection sampling from raw text would accept.

What is gathered: the counts of labelled documents come first, and those of all documents only for the buckets of which labels show that they may tell. Both
are sums in DataFrames, combined in the tasks. Labels are a bounded sample, the
``max_labels`` rows of the least hash; so what is broadcast, labels and buckets that may tell, is bounded by them. Texts are never shuffled (but where
repeated ids give more than ``BROADCAST_ROWS`` labelled rows).

Nulls and edges: a null text is empty; an empty text has no evidence and weight 1; a null id draws from the empty string and has no label unless a
label's id is null; labels with nulls or of ids without a document count for nothing; a document with several labels takes the worst; repeated rows
draw alike; a very long text is one row and read whole; equal keys at the threshold all stay; without labels of both kinds every weight is 1 and all
stay; an empty table gives an empty result. Extra columns, whatever their names, are kept by ``keep`` and left out by ``weights``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyloom.llm.shared import U64, bounded, free_names, lean, lowered, mix64, span_hashes, text_slices, unit_hash, word_bytes, written

BITS = 40
BUCKETS = 1 << BITS
SIGNIFICANT, TELLS, MOST, DISTINCT, RUN = 5.0, 10.0, 100.0, 8, 5
ADDED = ("_id", "_log_weight", "_key")
#: Labelled rows (8 bytes and a weight each) up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: (bucket, weight) pairs that a task gathers before it hands them on.
GATHERED = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Tokens between a token and its repetition, and how many in a row are repeated, of the n-grams that become one symbol.
PERIODS, REPEATS = (1, 2, 3), (2, 6, 24)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and runs of punctuation of a slice, and each text's first one (one more at the end)."""
    kind = word_bytes(data).astype(np.int8)
    kind[(kind == 0) & ~_SPACE[data]] = 2
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    change = kind[1:] != kind[:-1]
    starts = np.flatnonzero((kind != 0) & (np.concatenate([[True], change]) | edge[:-1]))
    ends = np.flatnonzero((kind != 0) & (np.concatenate([change, [True]]) | edge[1:])) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of a slice, each pair once: unigrams below BUCKETS, bigrams above."""
    words, first = tokens_of(data, offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = U64(64 - BITS)
    pairs = mix64(words[:-1] * U64(3) + words[1:])
    inside = text[:-1] == text[1:]
    found, of = [words >> shift, (pairs[inside] >> shift) + U64(BUCKETS)], [text, text[:-1][inside]]
    for period in PERIODS:
        same = (words[:-period] == words[period:]) & (text[:-period] == text[period:])
        at = np.arange(len(same))
        run = at - np.maximum.accumulate(np.where(same, -1, at)) if len(same) else at
        for n in REPEATS:
            hit = text[:-period][run == n]
            found.append(np.full(len(hit), (mix64(np.array([period * 100 + n], U64))[0] >> shift) + U64(BUCKETS)))
            of.append(hit)
    both = np.unique(np.concatenate(of) << (BITS + 1) | np.concatenate(found).astype(np.int64))
    return both >> (BITS + 1), both & (2 * BUCKETS - 1)


def least_runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the least hash of its runs of ``RUN`` tokens, which copies share and other texts don't; a shorter text goes by its tokens' sum."""
    words, first = tokens_of(data, offsets)
    n = np.diff(first)
    runs = words.copy()
    for i in range(1, min(RUN, len(words))):
        runs[:-i] = runs[:-i] * U64(0x100000001B3) + words[i:]
    whole = np.repeat(first[1:], n) - np.arange(len(words)) >= RUN
    runs = np.where(whole, mix64(runs), U64((1 << 64) - 1))
    least, some = np.zeros(len(n), U64), np.flatnonzero(n)
    if len(some):
        least[some] = np.where(n[some] >= RUN, np.minimum.reduceat(runs, first[some]), np.add.reduceat(words, first[some]))
    return least


class Lookup:
    """Places of values in a sorted array, most misses told by a small table of bits."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[values & (len(self.maybe) - 1)] = True

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``asked`` are there, and where."""
        which = np.flatnonzero(self.maybe[asked & (len(self.maybe) - 1)])
        at = np.searchsorted(self.values, asked[which])
        right = self.values[np.minimum(at, len(self.values) - 1)] == asked[which] if len(self.values) else np.zeros(0, bool)
        return which[right], at[right]


def _key(column: Column) -> Column:
    return F.xxhash64(column)


def sample(labels: DataFrame, max_labels: int, *, id_col: str = "doc_id") -> DataFrame:
    """(k, bad): hashed ids of a bounded sample of the labels, and whether they aren't target; written."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    bad = (F.col("quality").cast("int") == 0) | (F.col("toxic").cast("int") == 1)
    rows = rows.groupBy(_key(F.col(f"`{id_col}`")).alias("k")).agg(F.max(bad).alias("bad"))
    # a first cut by hash keeps what each task hands on small, however many labels there are
    share = min(1.0, 1.2 * max_labels / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
    return written(rows.orderBy(F.xxhash64("k"), "k").limit(max_labels), "quality-labels")


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (row, bad, t): row, bad and the text's least run."""
    for batch in batches:
        least = [least_runs(data, offsets) if len(data) else np.zeros(hi - lo, U64) for lo, hi, data, offsets in text_slices(lowered(batch.column(2)))]
        if least:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate(least).view(np.int64))], ["row", "bad", "copy"])


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, max_labels: int) -> DataFrame:
    """(row, bad, weight) of the labelled rows of ``docs``, row being a hash of id and text: one over the copies of a text with the same label; written."""
    rows = _rows(docs, id_col, text_col).join(F.broadcast(sample(labels, max_labels)), "k").select("row", "bad", "t")
    marks = written(bounded(rows).mapInArrow(lean(_copied), "row bigint, bad boolean, copy bigint"), "quality-copies")
    sizes = marks.groupBy("bad", "copy").agg(F.count("*").alias("n"))
    return written(marks.distinct().join(sizes, ["bad", "copy"]).select("row", "bad", (1 / F.col("n")).alias("weight")), "quality-labelled")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(_key(key).alias("k"), F.xxhash64(key, text).alias("row"), text.alias("t"))


def _summed(bucket: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """Each bucket once, and its sums."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [bucket[first], *[np.add.reduceat(w[order], first) for w in weights]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (t, weight, bad): sums of the weights by bucket, and of all buckets as bucket -1, of rows that aren't target and of those that are; handed on each
    time that ``GATHERED`` pairs are there."""
    parts = []

    def handed() -> pa.RecordBatch:
        sums = _summed(*map(np.concatenate, zip(*parts, strict=True)))
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.append(sums[0], -1)), *[pa.array(np.append(w, w.sum())) for w in sums[1:]]], ["bucket", "bad", "target"])

    for batch in batches:
        weight, bad = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in text_slices(lowered(batch.column(0))):
            text, bucket = features(data, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(bucket):
                w, b = weight[lo:hi][text], bad[lo:hi][text]
                parts.append(_summed(bucket, np.where(b, w, 0.0), np.where(b, 0.0, w)))
                if sum(len(p[0]) for p in parts) >= GATHERED:
                    yield handed()
    if parts:
        yield handed()


def _tallied(held):
    """Of (t): all documents with each bucket asked for, and of all buckets as bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        count, mass = np.zeros(len(asked.values), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in text_slices(lowered(batch.column(0))):
                if len(data):
                    _, bucket = features(data, offsets)
                    mass += len(bucket)
                    count += np.bincount(asked.find(bucket)[1], minlength=len(count))
        some = np.flatnonzero(count)
        if mass:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(asked.values[some], -1)), pa.array(np.append(count[some], mass))], ["bucket", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 200_000) -> dict:
    """The buckets in which the models differ, in order, and log p_target - log p_raw of each."""
    marks = labelled(docs, labels, id_col=id_col, text_col=text_col, max_labels=max_labels)
    model = {"bucket": np.zeros(0, np.int64), "log_ratio": np.zeros(0)}
    n = {r.bad: r["count"] for r in marks.groupBy("bad").count().collect()}
    if len(n) < 2:
        return model
    rows = _rows(docs, id_col, text_col)
    own = rows.select("row", "t").join(F.broadcast(marks) if sum(n.values()) <= BROADCAST_ROWS else marks, "row").select("t", "weight", "bad")
    # sums in any order are equal to the sixth place
    sums = bounded(own).mapInArrow(lean(_counted), "bucket bigint, bad double, target double").groupBy("bucket").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("bad", "target")])
    sums = written(sums.where((F.col("bad") >= DISTINCT) | (F.col("bucket") < 0)), "quality-sums")
    if (mass := sums.where("bucket < 0").first()) is None or not mass.target:
        return model
    alike = (F.col("bad") + F.col("target")) * (mass.target / (mass.bad + mass.target))
    shown = (F.col("bad") >= (F.col("target") + 1) * (TELLS * mass.bad / mass.target)) & (alike - F.col("target") >= SIGNIFICANT * F.sqrt(alike + 1))
    sums = sums.where((F.col("bucket") >= 0) & shown).toArrow().sort_by("bucket")
    if not sums.num_rows:
        return model
    n_target, asked = sums["target"].to_numpy(), Lookup(sums["bucket"].to_numpy())
    held = docs.sparkSession.sparkContext.broadcast(asked)
    tally = bounded(rows.select("t")).mapInArrow(lean(_tallied(held)), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().sort_by("bucket")
    held.unpersist()
    expected = tally["n"].to_numpy()[1:] * (mass.target / tally["n"][0].as_py())
    low = (n_target + 1) / (expected + 1)
    tells = (low <= 1 / TELLS) & (expected - n_target >= SIGNIFICANT * np.sqrt(expected + 1))
    return {"bucket": asked.values[tells], "log_ratio": np.maximum(np.log(low[tells]), -np.log(MOST))}


def _log_weights(model: dict, asked: Lookup, texts: pa.Array) -> np.ndarray:
    """log p_target - log p_raw of each text."""
    out = np.zeros(len(texts))
    for lo, hi, data, offsets in text_slices(lowered(texts)):
        if len(data) and len(model["bucket"]):
            text, bucket = features(data, offsets)
            which, at = asked.find(bucket)
            out[lo:hi] = np.bincount(text[which], model["log_ratio"][at], hi - lo)
    # sums of a text's ratios are the same in any slice, but for the last digits
    return np.round(out, 9)


def weighed(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, temperature: float = 1.0, whole_rows: bool = False) -> DataFrame:
    """Columns ADDED of each row; with ``whole_rows`` the rows' own columns before them, and those renamed if need be."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.columns if whole_rows else []
    *names, drawn, text = free_names(docs, *ADDED, "_u", "_text") if whole_rows else [*ADDED, "_u", "_text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{id_col}`").alias(names[0]), unit_hash(f"quality:{seed}", F.col(f"`{id_col}`")).alias(drawn), F.col(f"`{text_col}`").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Lookup(held.value["bucket"])
        for batch in batches:
            w = _log_weights(held.value, asked, batch.column(len(own) + 2))
            u = np.clip(batch.column(len(own) + 1).to_numpy(), 2.0**-53, 1 - 2.0**-53)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own) + 1], pa.array(w), pa.array(w - temperature * np.log(-np.log(u)))], [*own, *names])

    fields = [*rows.schema.fields[: len(own) + 1], *[StructField(n, DoubleType()) for n in names[1:]]]
    return bounded(rows).mapInArrow(lean(run), StructType(fields))


def drawn(keys: DataFrame, k: int | None) -> float:
    """The least key that is drawn, of rows with _log_weight and _key."""
    if k is None:
        k = round(keys.agg(F.round(F.sum(F.least(F.lit(1.0), F.exp("_log_weight"))), 6)).first()[0] or 0)
    return threshold(keys, k)


def threshold(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest value of column ``_key``: counts in equal bins, again within the bin that holds it, until that bin has one value."""
    if k <= 0:
        return float("inf")
    lo, hi = keys.agg(F.min("_key"), F.max("_key")).first()
    while lo is not None and lo < hi:
        width = (hi - lo) / bins
        if not width or lo + width == lo:
            return lo
        inside = keys.where(F.col("_key").between(lo, hi))
        bin_of = F.least(F.floor((F.col("_key") - lo) / width), F.lit(bins - 1))
        got = inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect()
        above = keys.where(F.col("_key") > hi).count()
        for r in sorted(got, key=lambda r: -r.b):
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
        else:
            return lo
    return lo if lo is not None else float("inf")


def weights(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 200_000, seed: int = 0, temperature: float = 1.0, k: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, gumbel_key, keep."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, max_labels=max_labels)
    rows = written(weighed(docs, model, id_col=id_col, text_col=text_col, seed=seed, temperature=temperature), "quality-weights")
    least = drawn(rows, k)
    return rows.select(F.col("_id").alias("doc_id"), F.col("_log_weight").alias("log_weight"), F.col("_key").alias("gumbel_key"), (F.col("_key") >= F.lit(least)).alias("keep"))


def keep(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 200_000, seed: int = 0, temperature: float = 1.0, k: int | None = None) -> DataFrame:
    """``docs`` without the rejected rows.  Rows are weighed once for the threshold and once as they pass: no join, no shuffle of texts."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, max_labels=max_labels)
    at = {"id_col": id_col, "text_col": text_col, "seed": seed, "temperature": temperature}
    least = drawn(written(weighed(docs, model, **at).select("_log_weight", "_key"), "quality-keys"), k)
    rows = weighed(docs, model, **at, whole_rows=True)
    return rows.where(F.col(f"`{rows.columns[-1]}`") >= F.lit(least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """The documents that are drawn."""
    rows = weights(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.where("keep").drop("keep")
