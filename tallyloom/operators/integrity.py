"""Checks of keys, references and coverage; they return offending rows, or raise in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def conflicting(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(*key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def dangling(rows: DataFrame, other: DataFrame, *key: str, allowed: dict[str, str] | None = None) -> DataFrame:
    """Rows whose key isn't in ``other``; keys in ``allowed`` have their reason, others null."""
    out = rows.join(other.select(*key).distinct(), list(key), "left_anti")
    reasons = F.create_map(*[F.lit(x) for kv in (allowed or {"": ""}).items() for x in kv])
    return out.withColumn("reason", F.try_element_at(reasons, F.col(key[-1]).cast("string")))


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side without a partner, as a multiset: side, and the row's columns."""
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


def require_empty(offending: DataFrame, what: str) -> None:
    """Raises with some of the offending rows."""
    if found := offending.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def require_count(rows: DataFrame, expected: int | None, what: str) -> None:
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{what}: {n} rows, {expected} expected")


def disjoint_union(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """The union of two row sets; a key in both is an error."""
    require_empty(a.select(*key).intersect(b.select(*key)), "in both")
    return a.unionByName(b)
