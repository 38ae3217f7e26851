"""What the blockwise operators share: tables sent to the tasks in blocks, and running tops of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch, at most: a batch is held some times over, in the JVM's direct memory and in Python, and texts can be long.
BATCH_ROWS = 1000


def bounded(spark: SparkSession) -> None:
    """From now on the session sends Arrow batches of at most ``BATCH_ROWS`` rows."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def loaded(block: Broadcast):
    """A broadcast block's value, which the worker doesn't keep: of many blocks it holds one at a time."""
    value = block.value
    if getattr(block, "_path", None) and getattr(block, "_sc", None) is None:
        block.__dict__.pop("_value", None)
    return value


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the session has cores, at least, so that work on few rows of a small file is shared."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, 8))


def chunks(batches: Iterator, rows: int) -> Iterator[tuple[list, list]]:
    """The first two columns of Arrow batches, as lists of about ``rows`` rows."""
    a, b = [], []
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            a += part.column(0).to_pylist()
            b += part.column(1).to_pylist()
            if len(a) >= rows:
                yield a, b
                a, b = [], []
    if a:
        yield a, b


class Best:
    """The k best items of each group, by score rounded to 9 places and then by the item's name; what it holds is bounded by groups * k.

    ``least`` is a score below which nothing can enter a group any more.
    """

    def __init__(self, groups: int, k: int):
        self.k, self.least, self.limit = k, np.full(groups, -np.inf), max(3 * groups * k, 200_000)
        self.names, self.group, self.item, self.score, self.n = np.empty(0, object), [], [], [], 0

    def add(self, names: np.ndarray, group: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        """``item`` counts in ``names``, those of this block."""
        if not len(group):
            return
        self.group.append(group.astype(np.int32))
        self.item.append((item + len(self.names)).astype(np.int32))
        self.score.append(score)
        self.names = np.concatenate([self.names, names])
        self.n += len(group)
        if self.n > self.limit:
            self.prune()

    def prune(self) -> None:
        """Drops what is worse than its group's k-th score; of scores equal to it no more than half k are kept besides."""
        if not self.n:
            return
        group, item, score = np.concatenate(self.group), np.concatenate(self.item), np.concatenate(self.score)
        order = np.argsort(group.astype(np.int16) if len(self.least) < 32_768 else group, kind="stable")
        group, item, score = group[order], item[order], score[order]
        ends = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
        kept, rank = np.ones(len(group), bool), None
        for a, b in zip(ends[:-1], ends[1:]):
            if b - a < self.k:
                continue
            self.least[group[a]] = least = np.partition(score[a:b], b - a - self.k)[b - a - self.k] - 2e-9
            kept[a:b] = score[a:b] >= least
            near = a + np.flatnonzero(kept[a:b])
            if len(near) > 1.5 * self.k:  # ties: the first by name
                rank = self._name_rank() if rank is None else rank
                kept[near[np.lexsort((rank[item[near]], -np.round(score[near], 9)))[self.k :]]] = False
        used, item = np.unique(item[kept], return_inverse=True)
        self.names = self.names[used]
        self.group, self.item, self.score, self.n = [group[kept]], [item.astype(np.int32)], [score[kept]], len(item)

    def _name_rank(self) -> np.ndarray:
        if self.names.size and isinstance(self.names[0], str):
            by_name = np.array(sorted(range(len(self.names)), key=self.names.__getitem__))
        else:
            by_name = np.argsort(self.names.astype(np.int64), kind="stable")
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        return rank

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, name and score, by group and place."""
        self.prune()
        if not self.n:
            return np.empty(0, np.int64), np.empty(0, object), np.empty(0)
        group, item, score = self.group[0], self.item[0], self.score[0]
        order = np.lexsort((self._name_rank()[item], -np.round(score, 9), group))
        group, item, score = group[order], item[order], score[order]
        first = np.r_[True, group[1:] != group[:-1]]
        kept = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0)) < self.k
        return group[kept], self.names[item[kept]], score[kept]


def top_of_block(best: Best, names: np.ndarray, score: np.ndarray, allowed: np.ndarray | None = None) -> None:
    """Adds a block of scores (groups, items) to ``best``; of groups that aren't full yet only what the block's own k-th score permits."""
    least = best.least
    if not np.isfinite(least).all() and allowed is None and score.shape[1] > best.k:
        least = np.maximum(least, np.partition(score, -best.k, axis=1)[:, -best.k] - 2e-9)
    hit = score >= least[:, None]
    if allowed is not None:
        hit &= allowed
    group, item = np.nonzero(hit)
    best.add(names, group, item, score[group, item])
