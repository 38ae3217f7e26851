"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's bytes start as single symbols in a linked list; a heap yields the adjacent pair of lowest rank, leftmost first;
merging it removes one symbol and may offer two new pairs.  The count is initial symbols minus merges; no identifiers are
made.  Texts are cut at white space into pieces that the pre-tokeniser treats alone, pieces are hashed in numpy, and each distinct
piece is counted once per worker (a cache of bounded size), so the merging runs over distinct strings, not over all words.

Of a tokenizer file it needs a byte-level BPE without normaliser, as its pre-tokeniser's usual pattern splits it; others are refused.

Nulls and edges: a null or empty text has 0 bytes and 0 tokens; strings of added tokens inside a text count as one token each, as the
library has it; a very long text is one row, read whole (a piece of it takes some 100 bytes a byte while it is merged); ties of pairs go to the left one, as the
library has it; pieces that differ have different 64-bit hashes but for a chance of 5e-20 a pair; repeated rows give repeated rows; an empty table gives an empty result.  Extra columns are left out.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import bounded, lean, span_hashes, text_slices

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache, about 150 bytes each.
CACHE = 1_000_000


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter:
    def __init__(self, spec: str):
        tok = json.loads(spec)
        pre, model = tok.get("pre_tokenizer") or {}, tok["model"]
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or tok.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only a byte-level BPE without normaliser or prefix space is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or regex.search(r"\s", t["content"]) for t in tok.get("added_tokens", [])):
            raise ValueError("added tokens that hold or strip spaces, or need word edges, aren't supported")
        ids = model["vocab"]
        self.first = [ids[s] for s in _byte_symbols()]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(ids[a] << 32) | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        added = sorted((t["content"] for t in tok.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.split = regex.compile(PATTERN).findall
        self.pieces: dict[int, int] = {}
        self.words: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """Symbols left of ``word`` when no pair can be merged."""
        ranks, first = self.ranks, self.first
        sym = [first[b] for b in word]
        n = left = len(sym)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if hit := ranks.get((sym[i] << 32) | sym[i + 1]):
                heap.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j], left = new, -1, left - 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := ranks.get((new << 32) | sym[k]):
                    heapq.heappush(heap, (hit[0], i, new, sym[k], hit[1]))
            h = before[i]
            if h >= 0 and (hit := ranks.get((sym[h] << 32) | new)):
                heapq.heappush(heap, (hit[0], h, sym[h], new, hit[1]))
        return left

    def count(self, text: str) -> int:
        total = 0
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                total += 1
                continue
            for w in self.split(part):
                n = self.words.get(w)
                if n is None:
                    n = self.merged(w.encode())
                    if len(w) <= 64:
                        if len(self.words) >= CACHE:
                            self.words.clear()
                        self.words[w] = n
                total += n
        return total

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for lo, hi, data, offsets in text_slices(texts):
            n_bytes[lo:hi] = np.diff(offsets)
            if not len(data):
                continue
            starts = piece_starts(data, offsets)
            ends = np.append(starts[1:], len(data))
            keys, at, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            each = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys.tolist()):
                n = self.pieces.get(key)
                if n is None:
                    if len(self.pieces) >= CACHE:
                        self.pieces.clear()
                    n = self.pieces[key] = self.count(data[starts[at[i]] : ends[at[i]]].tobytes().decode())
                each[i] = n
            run = np.concatenate([[0], np.cumsum(each[back])])
            n_tokens[lo:hi] = np.diff(run[np.searchsorted(starts, offsets)])
        return n_bytes, n_tokens


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes after which no cut is made: separators of other kinds, and, at the end of a longer character, what might be a space.
_NO = np.zeros(256, dtype=bool)
_NO[28:32] = True
_NO[[0x80 + i for i in range(11)] + [0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at a text's start, and at a white-space byte after one that surely isn't white space."""
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = _SPACE[data[1:]] & ~_SPACE[data[:-1]] & ~_NO[data[:-1]]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.  The file is read on the driver and sent to the tasks (a few MB)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    held: list[Counter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not held:
                held.append(_counter(spec.value))
            n_bytes, n_tokens = held[0].column(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return bounded(rows).mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


_COUNTERS: dict[int, Counter] = {}


def _counter(spec: str) -> Counter:
    """One counter for each vocabulary and worker, kept between tasks."""
    if hash(spec) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[hash(spec)] = Counter(spec)
    return _COUNTERS[hash(spec)]


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
