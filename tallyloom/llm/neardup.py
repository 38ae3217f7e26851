"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded, then verified by exact multiset overlap.

A text is the multiset of its shingles of ``SHINGLE`` words (lower case; a text of fewer words is one shingle). Each shingle has Poisson processes on
its weight axis: the first unit, and then intervals that double, [1, 2), [2, 4), [4, 8) and so on. A point has a time, exponential steps apart at a
rate of the interval's width; a component of the signature; and a place in the interval, given by as many hash bits as the interval has halvings. It
counts if its place lies below the shingle's weight, so equal shingles share all points below the lesser weight, and a component's earliest point is
equal in two texts with probability sum(min) / sum(max), the weighted Jaccard similarity (Ertl, "BagMinHash", 2018). Points are drawn in order of time
up to a limit after which all components are filled in nearly all cases, about ``M`` * (ln ``M`` + 4) points however long the text is; texts with a
gap are drawn again with twice the limit, so signatures are exact.

Texts with equal multisets are one node from then on. Nodes share a bucket if one of ``BANDS`` bands of ``ROWS`` components agrees: at similarity 0.8
all bands fail with probability 2e-4. In each bucket all nodes are compared with one leader, the node with the most neighbours in its buckets, so a
group of n copies costs n comparisons and not n * n. Of the pairs of a bucket that are then left in different classes, those are compared that can
still be similar enough: 1 - similarity is a metric, so their distances to the leader differ by no more than the permitted distance; and their
differences from the leader, kept as bit maps, bound what they share. No bucket is capped, and nothing that could be a link is left out. Classes are
the connected components of verified pairs.

Only texts of nodes with a bucket in common move, and never those of exact copies, as long as the list of their rows is small enough to be broadcast
(``BROADCAST_ROWS``); a longer list is joined, and for that all texts are exchanged once. A bucket with very many nodes is cut into parts for the second
comparison. Tables in between are narrow and written to the shared folder;
neither pairs nor labels reach the driver.

Nulls and edges: a null text is empty; texts without words are one class; repeated rows are exact copies; a null id belongs to its class, whose id is
the least one that isn't null (null if all are). An empty table gives an empty result. Extra columns are kept by ``keep_one`` and left out by
``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import U64, bounded, components, free_names, lean, lowered, mix64, text_slices, words_of, written

SHINGLE = 5
M, BANDS, ROWS = 64, 16, 4
GAP = 4.0
#: Bits of the maps of differences from a leader.
BITS = 512
_STEP, _PART, _TOP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
#: Rows of ``dropped`` (8 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 1_000_000
#: Parts of the rows and columns of a bucket's pairs, times the root of its nodes.
SQUARE = 1 / 12


def _wrapped(x: int) -> np.uint64:
    return U64(x & ((1 << 64) - 1))


def shingles_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of a slice, in order of text and shingle."""
    n = np.diff(first)
    h = np.zeros(len(words), U64)
    for i in range(min(SHINGLE, len(words))):
        h[: len(words) - i] = h[: len(words) - i] * U64(0x100000001B3) + words[i:]
    text = np.repeat(np.arange(len(n)), n)
    left = np.repeat(first[1:], n) - np.arange(len(words))
    use = left >= SHINGLE
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    for t in short.tolist():
        value = 0
        for w in words[first[t] : first[t + 1]].tolist():
            value = value * 0x100000001B3 + w
        h[first[t]], use[first[t]] = _wrapped(value + int(n[t])), True
    text, h = text[use], mix64(h[use])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, m: int = M) -> np.ndarray:
    """(texts, m) identifiers of the earliest points; rows of texts without shingles are 0."""
    total = np.bincount(text, weight, n_texts)
    out = np.zeros((n_texts, m), U64)
    todo = total > 0
    limit = np.zeros(n_texts)
    limit[todo] = m * (np.log(m) + GAP) / total[todo] / m
    while todo.any():
        mine = todo[text]
        got, filled = _drawn(text[mine], shingle[mine], weight[mine], limit * m, n_texts, m)
        done = todo & filled
        out[done] = got[done]
        todo &= ~filled
        limit *= 2
    return out


def _drawn(text, shingle, weight, limit, n_texts: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all points up to each text's limit of time, and whether they have no gap."""
    # intervals: [0, 1) of all, [2**(j-1), 2**j) of those that reach into it
    parts = [(np.arange(len(text)), 0.0, 1.0, 0)]
    j = 1
    while (some := np.flatnonzero(weight > 1 << (j - 1))).size:
        parts.append((some, float(1 << (j - 1)), float(1 << (j - 1)), j))
        j += 1
    of = np.concatenate([p[0] for p in parts])
    low, width = (np.concatenate([np.full(len(p[0]), p[k]) for p in parts]) for k in (1, 2))
    seed = mix64(shingle[of] + _TOP * np.concatenate([np.full(len(p[0]), p[3], U64) for p in parts]))
    owner, most, at = text[of], weight[of].astype(float), np.zeros(len(of))
    until = limit[owner]
    slots, times, names = [], [], []
    step = 0
    while len(of):
        step += 1
        point = mix64(seed + _wrapped(int(_STEP) * step))
        # the time's step has the upper bits, the component the lowest; a second hash has the place
        at = at - np.log(((point >> U64(11)).astype(float) + 0.5) * 2.0**-53) / width
        go = at <= until
        of, low, width, seed, owner, most, at, until, point = (x[go] for x in (of, low, width, seed, owner, most, at, until, point))
        place = mix64(point ^ _PART)
        inside = low + np.floor((place >> U64(11)).astype(float) * 2.0**-53 * width) < most
        slots.append((owner * m + (place & U64(m - 1)).astype(np.int64))[inside])
        times.append(at[inside])
        names.append(point[inside])
    slot, time, name = map(np.concatenate, (slots, times, names))
    order = np.argsort(-time, kind="stable")
    out, have = np.zeros(n_texts * m, U64), np.zeros(n_texts * m, bool)
    out[slot[order]] = name[order]  # the last write, that of the earliest point, stays
    have[slot] = True
    return out.reshape(n_texts, m), have.reshape(n_texts, m).all(1)


def _bands(signature: np.ndarray) -> np.ndarray:
    """One key for each band."""
    out = np.zeros((len(signature), BANDS), U64)
    for r in range(ROWS):
        out = mix64(out + signature[:, r::ROWS][:, :BANDS] + U64(r + 1))
    return mix64(out + np.arange(1, BANDS + 1, dtype=U64) * _STEP)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, bands = [], [], []
        for _, _, data, offsets in text_slices(lowered(batch.column(batch.num_columns - 1))):
            words, _, first = words_of(data, offsets)
            n = len(offsets) - 1
            text, shingle, weight = shingles_of(words, first)
            size = np.bincount(text, weight, n).astype(np.int64)
            w = weight.astype(U64)
            key = np.zeros((n, 2), U64)
            # a multiset's name: two sums over its shingles
            for lane in (0, 1):
                run = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(shingle + _wrapped((lane + 1) * int(_PART))) * w, dtype=U64)])
                ends = np.searchsorted(text, np.arange(n + 1))
                key[:, lane] = run[ends[1:]] - run[ends[:-1]]
            key[:, 1] += size.astype(U64)
            nodes.append(key)
            sizes.append(size)
            bands.append(_bands(signatures(text, shingle, weight, n)))
        if not nodes:
            continue
        key, size, band = map(np.concatenate, (nodes, sizes, bands))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), pa.array(band.ravel().view(np.int64)))
        names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(size), [None, pa.py_buffer(np.ascontiguousarray(key).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], names, pa.array(size), listed], ["id", "row", "node", "size", "bands"])


def signed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (a hash of id and text), node (of the multiset), size (its shingles), bands, of each row of ``docs``; written."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("row"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(bounded(rows).mapInArrow(lean(_signed), f"id {kind}, row bigint, node binary, size bigint, bands array<bigint>"), "neardup-signed")


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of columns text_a and text_b: exact weighted Jaccard similarity, and how a differs: ``BITS``-bit maps of the shingles that it has less of (miss) and
    more of (extra) than b, and the weight of the latter.  A batch's equal texts share their shingles."""
    for batch in batches:
        kept: dict[str, tuple] = {}
        sims, miss, extra, more = [], [], [], []
        for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            for text in pair:
                if text not in kept:
                    kept[text] = _multiset(text)
            a, b = kept[pair[0]], kept[pair[1]]
            sims.append(_similarity(a, b))
            (less, _), (much, weight) = _excess(b, a), _excess(a, b)
            miss.append(_bitmap(less))
            extra.append(_bitmap(much))
            more.append(int(weight))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sims, pa.float64()), *[pa.array(x, pa.list_(pa.int64())) for x in (miss, extra)], pa.array(more, pa.int64())], ["a", "b", "sim", "miss", "extra", "n_extra"])


def _excess(a: tuple, b: tuple) -> tuple[np.ndarray, int]:
    """Shingles of which a has more than b, and by how much in all."""
    if not len(b[0]):
        return a[0], int(a[1].sum())
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    over = a[1] - np.where(b[0][at] == a[0], b[1][at], 0)
    return a[0][over > 0], int(over[over > 0].sum())


def _bitmap(shingles: np.ndarray) -> list[int]:
    bits = np.zeros(BITS, bool)
    bits[(shingles >> U64(20)) & U64(BITS - 1)] = True
    return np.packbits(bits).view(np.int64).tolist()


def _multiset(text: str) -> tuple[np.ndarray, np.ndarray]:
    for _, _, data, offsets in text_slices(lowered(pa.array([text], pa.string())), 1 << 60):
        words, _, first = words_of(data, offsets)
        _, shingle, weight = shingles_of(words, first)
        return shingle, weight
    return np.zeros(0, U64), np.zeros(0, np.int64)


def _similarity(a: tuple, b: tuple) -> float:
    """sum(min) / sum(max) of two multisets with sorted shingles."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return both / (total - both)


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """node, text of the wanted nodes (column node), from the row of ``docs`` that stands for each; written.  The list of rows is broadcast up to
    ``BROADCAST_ROWS`` (8 bytes each), so that other texts don't move; a longer one is joined by an exchange."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    listed = written(wanted.join(nodes.select("node", "row"), "node"), "neardup-wanted")
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("row"), text.alias("text"))
    keys = listed.select("row").distinct()
    if keys.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(keys), "row", "left_semi")
    # repeated rows have one hash: a single one of them is wanted
    return written(rows.join(listed, "row").groupBy("node").agg(F.first("text").alias("text")), "neardup-texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their similarity and differences."""
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return bounded(both.select("a", "b", "text_a", "text_b")).mapInArrow(lean(_overlap), "a binary, b binary, sim double, miss array<bigint>, extra array<bigint>, n_extra bigint")


def most_shared(x: str, y: str) -> F.Column:
    """A bound of the weight that texts x and y of one leader share, by their differences from it.

    Of the leader's shingles they can't share those that either has less of: at least as many as the union of the two maps has bits.  Of
    the rest, the weight that one has beyond the leader, less the bits of its map that the other's lacks.
    """
    bits = lambda f: sum((F.bit_count(f(i)) for i in range(1, BITS // 64)), F.bit_count(f(0)))
    column = lambda side, name: (lambda i: F.col(f"{side}.{name}")[i])
    missing = bits(lambda i: column(x, "miss")(i).bitwiseOR(column(y, "miss")(i)))
    beyond = [F.col(f"{a}.n_extra") - bits(lambda i, a=a, b=b: column(a, "extra")(i).bitwiseAND(F.bitwise_not(column(b, "extra")(i)))) for a, b in ((x, y), (y, x))]
    return F.col(f"{x}.leader_size") - missing + F.least(*beyond)


def links(docs: DataFrame, rows: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, classes): a row of ``docs`` for each node, the verified links a, b, sim between nodes of different texts, and node, label of all
    nodes that have links."""
    nodes = written(rows.groupBy("node").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("row"), F.min("id").alias("id"), F.first("size").alias("size"), F.first("bands").alias("bands")), "neardup-nodes")
    cells = nodes.where("size > 0").select("node", "size", F.explode("bands").alias("bucket"))
    shared = cells.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    cells = written(cells.join(shared, "bucket"), "neardup-cells")
    # a node with many neighbours in its buckets is likely a group's origin
    reach = cells.groupBy("node").agg(F.sum(F.log2("n")).alias("reach"))
    ranked = cells.join(reach, "node")
    leaders = ranked.groupBy("bucket").agg(F.max_by(F.struct("node", "size"), F.struct("reach", "node")).alias("l")).select("bucket", F.col("l.node").alias("leader"), F.col("l.size").alias("leader_size"))
    cells = written(cells.join(leaders, "bucket"), "neardup-led")
    pairs = written(cells.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "neardup-pairs")
    texts = texts_of(cells.select("node").distinct(), nodes, docs, id_col=id_col, text_col=text_col)
    first = written(verified(pairs, texts), "neardup-first")
    found = first.where(F.col("sim") >= threshold).select("a", "b", "sim")
    classes = components(found.select("a", "b"))
    # what is left: buckets with nodes of several classes; who isn't linked to the leader there may be to another one
    differ = first.select(F.col("a").alias("node"), F.col("b").alias("leader"), (1 - F.col("sim")).alias("d"), "miss", "extra", "n_extra")
    known = cells.where("node != leader").join(classes, "node", "left").select("bucket", "node", "leader", "size", "leader_size", F.coalesce("label", "node").alias("label"))
    several = known.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    known = known.join(several, "bucket", "left_semi").join(differ, ["node", "leader"]).join(nodes.select("node", "bands"), "node")
    known = written(known, "neardup-known")
    far = known.where(F.col("d") > 1 - threshold)
    # a bucket of n nodes is a square of pairs: its rows and columns are cut into SQUARE * sqrt(n) parts each, so that no task has them all
    parts = known.groupBy("bucket").agg(F.ceil(F.sqrt(F.count("*").cast("double")) * SQUARE).alias("parts")).where("parts > 1")
    own = lambda side: F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(side)), "parts"))
    all_parts = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    cut = lambda df: df.join(parts, "bucket", "left")
    x = cut(far).withColumn("row_part", own("x")).withColumn("column_part", F.explode(all_parts)).alias("x")
    y = cut(known).withColumn("column_part", own("y")).withColumn("row_part", F.explode(all_parts)).alias("y")
    most = most_shared("x", "y")
    open_pairs = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "row_part", "column_part")]).where(
        (F.col("x.label") != F.col("y.label")) & (F.abs(F.col("x.d") - F.col("y.d")) <= 1 - threshold + 1e-9)
        # of two far nodes one order is enough
        & ((F.col("y.d") <= 1 - threshold) | (F.col("x.node") < F.col("y.node")))
        & (most * (1 + threshold) >= F.lit(threshold) * (F.col("x.size") + F.col("y.size")) - 1e-6)
        # of the buckets that both are in, the least one has the pair
        & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket"))
    )
    second = written(open_pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), "neardup-open")
    if second.isEmpty():
        return nodes, found, classes
    more = written(verified(second, texts), "neardup-second").where(F.col("sim") >= threshold).select("a", "b", "sim")
    # of these only what joins two classes is left to follow
    of = lambda side: F.coalesce(F.col(f"label_{side}"), F.col(side)).alias(side)
    named = lambda side: classes.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    across = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(of("a"), of("b")).where("a != b")
    joined = components(across)
    ends = joined.select(F.col("node").alias("label"), F.col("label").alias("joined"))
    whole = classes.join(ends, "label", "left").select("node", F.coalesce("joined", "label").alias("label"))
    new = joined.join(classes.select("node"), "node", "left_anti").select("node", "label")
    return nodes, found.unionByName(more), written(whole.unionByName(new), "neardup-classes")


def classes(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least id of its class), n_links (verified links of its text with other texts), similarity (the
    greatest of these, null without one), row (a hash of id and text), class_row (that of the document that stands for the class).

    A text's links are those that were compared: with the leaders of its buckets, and with texts of other classes.
    """
    rows = signed(docs, id_col=id_col, text_col=text_col)
    nodes, found, label = links(docs, rows, threshold=threshold, id_col=id_col, text_col=text_col)
    each = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").distinct()
    each = each.select("a", "sim").union(each.select("b", "sim")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"), F.max("sim").alias("similarity"))
    labelled = nodes.join(label, "node", "left").join(each, "node", "left")
    labelled = written(labelled.select("node", "id", "row", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.round("similarity", 9).alias("similarity")), "neardup-labels")
    least = labelled.groupBy("label").agg(F.min("id").alias("class_id"), F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("class_row"))
    names = written(labelled.select("node", "label", "n_links", "similarity").join(least, "label").drop("label"), "neardup-names")
    return rows.select("id", "row", "node").join(names, "node").select(F.col("id").alias("doc_id"), "class_id", "n_links", "similarity", "row", "class_row")


def keep_one(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the least id; of rows that differ in other columns only, the first by these as JSON.

    What goes is anti-joined, so texts move only where more than ``BROADCAST_ROWS`` go; and those of repeated rows that stay.
    """
    found = written(classes(docs, threshold=threshold, id_col=id_col, text_col=text_col), "neardup-classes")
    key = F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    own, gone = free_names(docs, "_neardup_key", "_neardup_row")
    dropped = found.where("row != class_row").select(F.col("row").alias(gone)).distinct()
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    kept = docs.withColumn(own, key).join(dropped, F.col(own) == F.col(gone), "left_anti")
    twice = written(found.where("row = class_row").groupBy("row").count().where("count > 1").select(F.col("row").alias(gone)), "neardup-twice")
    if (n := twice.count()) == 0:
        return kept.drop(own)
    twice = F.broadcast(twice) if n <= BROADCAST_ROWS else twice
    once = kept.join(twice, F.col(own) == F.col(gone), "left_anti").drop(own)
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = kept.join(twice, F.col(own) == F.col(gone), "left_semi").groupBy(own).agg(F.min_by(every, F.to_json(every)).alias(gone))
    return once.union(first.select(*[F.col(f"{gone}.`{c}`").alias(c) for c in docs.columns]))


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "similarity")
