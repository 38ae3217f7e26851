"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

Words (lower case; see ``shared.words_of``) are the symbols.  A walk reads a window with a pointer: at step j it emits the word under
the pointer and moves on by one if bit j of the word's hash says so, so that strings a few edits apart fall into step again and edit
distance becomes Hamming distance between emitted sequences (Chakraborty, Goldenberg and Koucky 2016).  Each repetition has its own
walk and its own sample of steps; the emitted words at these steps make the key.  All sampled steps lie before the least item
length, so the pointer never leaves an item and verbatim copies always agree; and items are indexed from every word at which a whole
walk fits, so that edits near an item's start don't matter.  Repetitions are added until, of each length, simulated copies at the
largest permitted distance are found with the target recall.

An item of fewer than ``FEW`` words, or of a length that doesn't reach the target in ``MAX_TABLES`` repetitions, is searched for
exactly: cut into one piece more than edits are permitted, an edited copy has one piece as it is, so all places of all pieces are
candidates and none is missed.

Over a document the keys of all positions come from one backward recurrence per repetition,
``key_j[p] = emit_j[p] + (key_{j+1}[p+1] if bit_j[p] else key_{j+1}[p])``, in numpy over whole slices of text.

Each candidate's window (the item's size and the permitted edits at either side) is then verified exactly: the word edit distance between
the item and the nearest part of the window must be at most ``max_edit`` of the item's words, words being compared by 64-bit hashes.
Every candidate is verified; no cap.

The benchmark is sent to the tasks in blocks of about ``BLOCK_BYTES`` of text, and no table is added to an index of more than
``INDEX_BYTES`` (what is then left is searched for exactly), so whatever the benchmark's size, what is broadcast is bounded; the corpus
is scanned once per block.  The corpus itself is never shuffled.  ``Index.recall`` has the simulated recall of each length.

Nulls and edges: null and empty documents match nothing; a very long document is one row and read whole; of several places of an item in a document
the one of the fewest edits counts, of equal ones the first; items of no words are ignored; items of equal texts are all found; an item of fewer than ``MIN_WORDS`` words is found at
any place by ``matches``, but ``clean`` drops for it only documents that have just these words; repeated rows give repeated results; empty tables give an empty result.  Extra columns are kept by
``clean`` and left out by ``matches``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import U64, bounded, lean, lowered, mix64, text_slices, words_of

#: Words of the least item that ``clean`` looks for inside documents.
MIN_WORDS = 5
BLOCK_BYTES, INDEX_BYTES = 4 << 20, 96 << 20
#: Steps of a walk, and walks; items that need more walks are searched for by pieces.
WALK, MAX_TABLES = 12, 48
#: Items of fewer words have few places to start a walk from, and are searched for by pieces; longest piece looked up.
FEW, MAX_PIECE = 24, 8
#: Simulated copies of each level of lengths: each length below 64 words, doubling ones beyond.
TRIALS = 1000
#: Words of windows that are verified together.
VERIFIED = 1 << 17


def sequences(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in text_slices(lowered(pa.array(texts, pa.string()))):
        words, _, first = words_of(data, offsets)
        out += [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


class Keys:
    """Items and places by key."""

    def put(self, keys: np.ndarray, own: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.places = keys[order], own[order].astype(np.int32), places[order].astype(np.int32)
        # one bit for each of 64 to 128 values a key: most keys of documents end here
        size = 1 << max(16, int(len(keys)).bit_length() + 6)
        bits = np.zeros(size, bool)
        bits[(keys & U64(size - 1)).astype(np.int64)] = True
        self.bits = np.packbits(bits, bitorder="little")

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.items.nbytes + self.places.nbytes + self.bits.nbytes

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the words at which their first word would stand, for all equal keys."""
        at = np.flatnonzero(self.bits[((key >> U64(3)) & U64(len(self.bits) - 1)).astype(np.int64)] >> (key & U64(7)).astype(np.uint8) & 1)
        lo, hi = np.searchsorted(self.keys, key[at], "left"), np.searchsorted(self.keys, key[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(lo, n) + within
        return self.items[entry].astype(np.int64), np.repeat(at, n) - self.places[entry]


class Table(Keys):
    """One repetition: a walk of ``length`` steps of which ``sampled`` make the key."""

    def __init__(self, seed: int, length: int, n_sampled: int):
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(1, 1 << 63, dtype=U64) | U64(1)
        self.length = length
        # one step of each of n_sampled equal runs of steps: neighbours often emit the same word twice
        cuts = np.linspace(0, length, min(n_sampled, length) + 1).astype(int)
        self.weights = {int(rng.integers(a, b)): rng.integers(1, 1 << 63, dtype=U64) | U64(1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}

    def walk(self, words: np.ndarray) -> np.ndarray:
        """The key of the walk from each word."""
        n = len(words)
        steer = mix64(words ^ self.salt)
        key, moved = np.zeros(n + 1, U64), np.zeros(n, U64)
        for j in range(max(self.weights), -1, -1):
            np.copyto(moved, key[:-1])
            np.copyto(moved, key[1:], where=(steer & U64(1 << j)) != 0)
            if j in self.weights:
                moved += words * self.weights[j]
            key[:-1] = moved
        return key[:-1]

    def index(self, items: list[np.ndarray], which: list[int]) -> None:
        keys, own, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in which:
            n = len(items[i]) - self.length + 1
            keys.append(self.walk(items[i])[:n])
            own.append(np.full(n, i))
            places.append(np.arange(n))
        self.put(*map(np.concatenate, (keys, own, places)))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.get(self.walk(words))


class Pieces:
    """Exact search: of an item's ``permitted + 1`` pieces, so many edits leave one as it is."""

    def __init__(self, items: list[np.ndarray], permitted: np.ndarray, which: list[int]):
        found: dict[int, list] = {}
        for i in which:
            cuts = np.linspace(0, len(items[i]), min(int(permitted[i]) + 1, len(items[i])) + 1).astype(int).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                m = min(b - a, MAX_PIECE)
                found.setdefault(m, []).append((self._next(items[i][a : a + m], m), i, a))
        self.by_length: dict[int, Keys] = {}
        for m, rows in sorted(found.items()):
            keys, own, places = zip(*rows, strict=True)
            self.by_length[m] = Keys()
            self.by_length[m].put(np.concatenate(keys), np.array(own, np.int64), np.array(places, np.int64))

    @staticmethod
    def _next(words: np.ndarray, length: int, key: np.ndarray | None = None, done: int = 0) -> np.ndarray:
        """Keys of all runs of ``length`` words, from those of ``done`` words."""
        key = np.zeros(len(words) + 1, U64) if key is None else key
        for j in range(done, length):
            key = key[:-1] * U64(0x9E3779B97F4A7C15) + words[j:]
        return key

    def hits(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, key, done = [], None, 0
        for m, keys in self.by_length.items():
            if m <= len(words):
                key, done = self._next(words, m, key, done), m
                out.append(keys.get(key))
        return out


class Index:
    """Items of a benchmark block, ready to be searched for in documents."""

    def __init__(self, ids: list, texts: list[str], max_edit: float = 0.2, recall: float = 0.98, seed: int = 0):
        seqs = sequences(texts)
        kept = [i for i, s in enumerate(seqs) if len(s)]
        self.ids, self.items = [ids[i] for i in kept], [seqs[i] for i in kept]
        self.size = np.array([len(s) for s in self.items], np.int64)
        self.permitted = np.floor(self.size * max_edit + 1e-9).astype(np.int64)
        self.tables: list[Table] = []
        self.recall: dict[int, float] = {}
        exact = [i for i, s in enumerate(self.items) if len(s) < FEW]
        if which := [i for i, s in enumerate(self.items) if len(s) >= FEW]:
            exact += self._repeat(which, WALK, recall, seed + WALK)
        self.pieces = Pieces(self.items, self.permitted, exact)
        self.recall |= {int(self.size[i]): 1.0 for i in exact if int(self.size[i]) < FEW}
        #: All items' words, and where each item starts; no word is 0, which fills up windows.
        self.first = np.cumsum([0, *self.size.tolist()])[:-1]
        self.words = np.concatenate([*self.items, np.zeros(1, U64)])

    def _repeat(self, which: list[int], length: int, recall: float, seed: int) -> list[int]:
        """Adds tables until of each level of lengths ``recall`` of simulated copies at the permitted distance share a key at their place (and
        a standard error more, so that other copies do so too).  Returns the items of levels that don't come so far in MAX_TABLES."""
        rng = np.random.default_rng(seed)
        anchors = sum(len(self.items[i]) - length + 1 for i in which)
        n_sampled = 5 if anchors < 1 << 17 else 6
        levels: dict[int, list[int]] = {}
        for i in which:
            n = len(self.items[i])
            levels.setdefault(n if n < 64 else 1 << n.bit_length(), []).append(i)
        of, copies = [], []
        for own in levels.values():
            drawn = rng.choice(own, TRIALS, replace=len(own) < TRIALS).tolist()
            of += drawn
            copies.append([_edited(self.items[i], int(self.permitted[i]), rng) for i in drawn])
        of, level = np.array(of), np.repeat(np.arange(len(levels)), TRIALS)
        found = np.zeros(len(of), bool)
        target = min(1.0, recall + (recall * (1 - recall) / TRIALS) ** 0.5)
        added, lacking = 0, np.ones(len(levels), bool)
        while lacking.any() and added < MAX_TABLES and sum(t.nbytes for t in self.tables) < INDEX_BYTES:
            table = Table(seed * 1000 + added, length, n_sampled)
            table.index(self.items, which)
            self.tables.append(table)
            added += 1
            for k in np.flatnonzero(lacking).tolist():
                first = np.cumsum([0, *[len(c) for c in copies[k]]])
                items, places = table.hits(np.concatenate(copies[k]))
                t = np.clip(np.searchsorted(first, places + self.size[items] // 2, "right") - 1, 0, TRIALS - 1)
                right = (of[k * TRIALS + t] == items) & (np.abs(places - first[t]) <= self.permitted[items])
                found[k * TRIALS + t[right]] = True
            lacking &= np.bincount(level, found, len(levels)) < target * TRIALS
        share = np.bincount(level, found, len(levels)) / TRIALS
        self.recall |= {n: 1.0 if lacking[k] else float(share[k]) for k, n in enumerate(levels)}
        return [i for k, own in enumerate(levels.values()) if lacking[k] for i in own]

    def search(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, start word, edits) for each item in each text of a slice; of several places the best and first."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        found = [*[t.hits(words) for t in self.tables], *self.pieces.hits(words)] if len(words) else []
        if found:
            items, places = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            # keys of one text only: the walk's own word is the place plus an offset inside the item, so clip the place to the slice
            pair = np.unique(items << 40 | (places + (1 << 30)))
            items, places = pair >> 40, (pair & ((1 << 40) - 1)) - (1 << 30)
            # items of like sizes together, and so many that their windows take a few MB
            order = np.argsort(self.size[items], kind="stable")
            items, places, lo = items[order], places[order], 0
            while lo < len(items):
                n = max(1, min(512, VERIFIED // max(1, int(self.size[items[min(lo + 511, len(items) - 1)]] * 2))))
                self._verify(words, first, items[lo : lo + n], places[lo : lo + n], best)
                lo += n
        return sorted((d, i, s, e) for (d, i), (e, s) in best.items())

    def _verify(self, words, first, items, places, best) -> None:
        size, permitted = self.size[items], self.permitted[items]
        middle = np.clip(places + size // 2, 0, len(words) - 1)
        doc = np.searchsorted(first, middle, "right") - 1
        lo = np.maximum(places - permitted, first[doc])
        hi = np.minimum(places + size + permitted, first[doc + 1])
        width = int((size + 2 * permitted).max())
        at = lo[:, None] + np.arange(width)
        window = np.where(at < hi[:, None], words[np.minimum(at, len(words) - 1)], U64(0))
        of = np.arange(int(size.max()))
        item = np.where(of < size[:, None], self.words[np.minimum(self.first[items][:, None] + of, len(self.words) - 1)], U64(0))
        # an item within the permitted edits has all but so many of its words in the window
        there = np.zeros(item.shape, bool)
        for k in range(width):
            there |= item == window[:, k : k + 1]
        there &= item != 0
        go = np.flatnonzero(there.sum(1) >= size - permitted)
        if not len(go):
            return
        edits, end = infix_distance(item[go], size[go], window[go], (hi - lo)[go])
        for g, e, t in zip(go.tolist(), edits.tolist(), end.tolist(), strict=True):
            if e <= permitted[g]:
                key = (int(doc[g]), int(items[g]))
                start = max(int(lo[g]) + t - int(size[g]), int(first[doc[g]])) - int(first[doc[g]])
                best[key] = min(best.get(key, (e, start)), (e, start))

    def texts(self, column: pa.Array, whole: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """All that ``search`` finds; items of fewer than ``whole`` words only in texts that have just these words."""
        for lo, _, data, offsets in text_slices(lowered(column)):
            words, _, first = words_of(data, offsets)
            for d, i, s, e in self.search(words, first):
                if self.size[i] >= whole or (e == 0 and first[d + 1] - first[d] == self.size[i]):
                    yield lo + d, i, s, e


def infix_distance(item: np.ndarray, size: np.ndarray, window: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item (row, first ``size`` words) to any part of its window (first ``length`` words), and that part's end."""
    n, width = window.shape
    column = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((n, width + 1), np.int32)
    for i in range(int(size.max())):
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (window != item[:, i : i + 1]), row[:, 1:] + 1)
        new = np.minimum.accumulate(new - column, axis=1) + column
        row = np.where((i < size)[:, None], new, row)
    row = np.where(column[None, :] <= length[:, None], row, np.int32(1 << 30))
    end = row.argmin(1)
    return row[np.arange(n), end], end


def _edited(words: np.ndarray, edits: int, rng) -> np.ndarray:
    """A copy with so many random substitutions, insertions and deletions, between other words."""
    out = words.tolist()
    for _ in range(edits):
        p, new = int(rng.integers(len(out))), int(rng.integers(1 << 62))
        kind = int(rng.integers(3))
        if kind == 0:
            out[p] = new
        elif kind == 1:
            out.insert(p, new)
        elif len(out) > 1:
            del out[p]
    around = rng.integers(1 << 62, size=16).tolist()
    return np.array(out + around, U64)


def indexes(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", max_edit: float = 0.2, recall: float = 0.98) -> Iterator[Index]:
    """The benchmark's index, in blocks of at most about BLOCK_BYTES of text."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()[0]
    n = 1 + total // BLOCK_BYTES
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        got = (rows.where(block == k) if n > 1 else rows).collect()
        got.sort(key=lambda r: (r.i is None, str(r.i), r.t))
        yield Index([r.i for r in got], [r.t for r in got], max_edit, recall)


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_edit: float = 0.2, recall: float = 0.98) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start_word, edits, item_words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    parts = [
        bounded(rows).mapInArrow(lean(_finder(docs.sparkSession.sparkContext.broadcast(index))), f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word bigint, edits bigint, item_words bigint")
        for index in indexes(benchmark, id_col=item_col, text_col="text", max_edit=max_edit, recall=recall)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _finder(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = held.value
            got = list(index.texts(batch.column(1)))
            d, i = [g[0] for g in got], [g[1] for g in got]
            columns = [batch.column(0).take(pa.array(d, pa.int64())), pa.array([index.ids[x] for x in i]), *[pa.array(x, pa.int64()) for x in ([g[2] for g in got], [g[3] for g in got], index.size[i].tolist() if i else [])]]
            if got:
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start_word", "edits", "item_words"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", max_edit: float = 0.2, recall: float = 0.98) -> DataFrame:
    """``docs`` without the rows in which an item was found, in one pass and without a shuffle for each block."""
    at = docs.columns.index(text_col)
    for index in indexes(benchmark, id_col=item_col, max_edit=max_edit, recall=recall):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in held.value.texts(batch.column(at), MIN_WORDS)]] = False
                yield batch.filter(pa.array(keep))

        docs = bounded(docs).mapInArrow(lean(run), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
