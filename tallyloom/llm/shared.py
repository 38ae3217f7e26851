"""What several operators share: written intermediate tables, and words of Arrow text as numpy arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import work_folder as shared_folder

U64 = np.uint64


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end the tables that ``written`` made in it are deleted: for callers that have stored their result by then."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe when executors are lost.  It stays unless a ``scratch`` scope ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front as long as ``df`` has a column so called (in any case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def unit_hash(tag: str, *cols) -> "F.Column":
    """A number in [0, 1) from the SHA-256 of ``tag`` and the columns: the same on every run and engine."""
    text = F.concat_ws(":", F.lit(tag), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: Rows of an Arrow batch, at most: a batch is held some times over, in the JVM's direct memory and in Python, and texts can be long.
BATCH_ROWS = 1000


def bounded(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends Arrow batches of at most ``BATCH_ROWS`` rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def lean(run: Callable) -> Callable:
    """A function of Arrow batches that gives freed memory back at its end: Python workers live on, idle, while other stages need the room."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return own


# --- numpy -----------------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n + 1, 1 << 18)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            a = np.full(size, b, dtype=U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of one running polynomial sum, moved to the span's start."""
    power, inverse = _powers(len(data))
    run = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=run[1:])
    return mix64((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(U64))


_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _WORD[_c] = True
_WORD[128:] = True


def word_bytes(data: np.ndarray) -> np.ndarray:
    """True where a byte belongs to a word: ASCII letters and digits, and other characters but spaces and general punctuation."""
    word = _WORD[data]
    if len(data) and data.max() >= 0xC2:
        two = data[:-1].astype(np.uint16) << 8 | data[1:]
        for at in np.flatnonzero((two == 0xC2A0) | (two == 0xC285) | (two == 0xC2AB) | (two == 0xC2BB)):
            word[at : at + 2] = False
        for at in np.flatnonzero((two == 0xE280) | (two == 0xE281) | (two == 0xE380)):
            if two[at] != 0xE380 or data[at + 2] <= 0x91:  # U+2000-207F, U+3000-3011
                word[at : at + 3] = False
    return word


def text_slices(column: pa.Array, budget: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole texts of about ``budget`` bytes; a longer text stands alone.

    Yields first row, row after the last, the bytes, and the texts' offsets in them.  Nulls count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a slice (of lower-case bytes), their start bytes, and each text's first word (one more at the end)."""
    word = word_bytes(data)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a word never crosses texts
    before = np.zeros(len(data), dtype=bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return span_hashes(data, starts, ends), starts, np.searchsorted(starts, offsets)


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


# --- classes ---------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row per node with its component's least node as ``label``.

    Each round a node takes the least label among its own, its neighbours' and that of the node its label names (so labels
    travel twice as far each round).  Minima are combined before they move, so a node with very many neighbours is one row per task.
    Labels are written each round and stay on the executors' side; rounds end when no label changes.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = labels.join(near, "node").join(jump, "label", "left").select("node", F.col("label").alias("old"), F.least("label", "near", "jump").alias("label"))
        new = written(new, "labels")
        if new.where("label != old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
