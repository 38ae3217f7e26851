"""URL filters: host and path rules, and an exact blocklist in a cascade of Bloom filters.

The cascade: its first filter holds the listed keys; the second those keys of the corpus's complete key universe that the first lets through without
being listed (its false positives); the third the listed keys that the second lets through; and so on until a filter has none. A key of the universe
is listed if the number of filters that let it through, before the first that doesn't, is odd. So membership is exact, with about a few bits for each
listed key and no join of pages to the list. Keys outside the universe may be judged wrongly, which can't happen here: the universe is all hosts of
the table that is judged.

Filters are built in one pass over the keys for each level, as bit ranges that are united on the executors. The keys are split by hash into as many
blocks as keep each block's cascade under ``BLOCK_BITS`` in all; pages pass once for each block, with that block's filters broadcast, so what is
broadcast is bounded whatever the list's size. A host with a third of all pages is one key.

Rules come first: of the rules whose host is the page's or one of its parents, and whose path its path starts with, the longest (host, then path)
decides; without one the cascade does.

The list is an argument; the tables have none, so the query takes ``stand_in_list``.

Nulls and edges: a very long url is read whole; of rules of equal lengths that fit the later one in the given order decides; a null url, or one without ``://``, has empty host and path, and the empty host is never listed; repeated rows are judged alike; an
empty table, or an empty list, gives filters without bits. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import U64, mix64, written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bits of one block's cascade, 16 MB.
BLOCK_BITS = 1 << 27
#: Bits that a block may take for each listed key, all levels together.
KEY_BITS = 24
#: Bits of a filter that are united together.
RANGE = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits; null without one."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(out)
    return out


class Cascade:
    """Filters of one block: ``levels`` holds (bits, hashes, seed) of each."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, int, int]] = []

    def passed(self, keys: np.ndarray) -> np.ndarray:
        """How many filters let each key through before the first that doesn't."""
        count, going = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for bits, hashes, seed in self.levels:
            ok = np.ones(len(going), bool)
            for place in places(keys[going], len(bits) * 8, hashes, seed):
                ok &= (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1) == 1
            going = going[ok]
            count[going] += 1
        return count

    def listed(self, keys: np.ndarray) -> np.ndarray:
        return self.passed(keys) % 2 == 1


def places(keys: np.ndarray, n_bits: int, hashes: int, seed: int) -> list[np.ndarray]:
    return [(mix64(keys.view(U64) + U64((seed * 64 + i + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))) % U64(n_bits)).astype(np.int64) for i in range(hashes)]


def _united(keys: DataFrame, n_bits: int, hashes: int, seed: int) -> np.ndarray:
    """The filter of all keys (column ``key``): ranges of bits are set in each task and united by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, np.ndarray] = {}
        for batch in batches:
            for place in places(batch.column(0).to_numpy(), n_bits, hashes, seed):
                for r in np.unique(place // RANGE).tolist():
                    own = place[place // RANGE == r] % RANGE
                    np.bitwise_or.at(ranges.setdefault(r, np.zeros(RANGE // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        for r, bits in ranges.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["range", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        bits = np.zeros(RANGE // 8, np.uint8)
        for x in table["bits"]:
            bits |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"range": table["range"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    parts = keys.select("key").mapInArrow(run, "range bigint, bits binary").withColumn("half", F.spark_partition_id() % 64)
    parts = parts.groupBy("range", "half").applyInArrow(unite, "range bigint, bits binary").groupBy("range").applyInArrow(unite, "range bigint, bits binary")
    out = np.zeros(-(-n_bits // RANGE) * RANGE // 8, np.uint8)
    for r in parts.collect():
        out[r["range"] * RANGE // 8 : (r["range"] + 1) * RANGE // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out[: n_bits // 8]


def build(keys: DataFrame, n_listed: int, n_other: int) -> Cascade:
    """The cascade over a block of the universe (columns key, listed): two false-positive rates as in certificate revocation lists
    (Larisch et al., "CRLite", 2017), one level after another."""
    cascade = Cascade()
    inside, outside = n_listed, n_other
    own = F.col("listed")
    waiting = keys
    while inside:
        level = len(cascade.levels)
        rate = 0.5 if level else min(0.5, math.sqrt(0.5) * inside / max(outside, 1))
        hashes = max(1, round(-math.log2(rate)))
        n_bits = max(64, -(-math.ceil(1.44 * inside * -math.log2(rate)) // 64) * 64)
        members = waiting.where(own if level % 2 == 0 else ~own)
        cascade.levels.append((_united(members, n_bits, hashes, level), hashes, level))
        held = keys.sparkSession.sparkContext.broadcast(cascade)

        def through(batches: Iterator[pa.RecordBatch], held=held, level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(held.value.passed(batch.column(0).to_numpy()) > level))

        # this level's members all pass; of the others those that pass are encoded next
        waiting = written(waiting.mapInArrow(through, "key bigint, listed boolean"), "urls-waiting")
        inside = waiting.where(~own if level % 2 == 0 else own).count()
        held.unpersist()
    return cascade


def cascades(universe: DataFrame, listed: DataFrame, *, block_bits: int = BLOCK_BITS) -> tuple[int, Iterator[tuple[int, Cascade]]]:
    """Number of blocks, and each block's number and cascade.  ``universe`` and ``listed`` have a column ``host``."""
    hosts = universe.where("host != ''").groupBy("host").agg(F.lit(False).alias("listed"))
    both = hosts.unionByName(listed.where("host != ''").select("host", F.lit(True).alias("listed")))
    keys = written(both.groupBy(F.xxhash64("host").alias("key")).agg(F.bool_or("listed").alias("listed")), "urls-universe")
    total = keys.where("listed").count()
    n = 1 + total * KEY_BITS // block_bits

    def each() -> Iterator[tuple[int, Cascade]]:
        for k in range(n):
            own = keys.where(F.pmod(F.col("key"), F.lit(n)) == k)
            sizes = dict(own.groupBy("listed").count().collect())
            yield k, build(own, sizes.get(True, 0), sizes.get(False, 0))

    return n, each()


def judge(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    n, blocks = cascades(rows.select("host"), listed, block_bits=block_bits)
    rows = rows.select("*", F.xxhash64("host").alias("_key"), F.lit(False).alias("listed"))
    kind = rows.schema["page_id"].dataType.simpleString()
    for k, cascade in blocks:
        held = pages.sparkSession.sparkContext.broadcast(cascade)

        def run(batches: Iterator[pa.RecordBatch], held=held, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(3).to_numpy()
                mine = np.mod(key, n) == k
                found = batch.column(4).to_numpy(zero_copy_only=False).copy()
                found[mine] = held.value.listed(key[mine])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found)], ["page_id", "host", "path", "_key", "listed"])

        rows = rows.mapInArrow(run, f"page_id {kind}, host string, path string, _key bigint, listed boolean")
    rows = rows.withColumn("listed", F.col("listed") & (F.col("host") != "")).withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    return rows.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def stand_in_list(pages: DataFrame, *, url_col: str = "url") -> DataFrame:
    """A list for want of one among the tables, which owes nothing to the rules: the hosts whose SHA-256 begins with 0 or 1, about an eighth."""
    hosts = pages.select(host_of(F.col(f"`{url_col}`")).alias("host")).where("host != ''").distinct()
    return hosts.where(F.substring(F.sha2("host", 256), 1, 1).isin("0", "1"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, stand_in_list(pages))


ORACLE = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM b),
d AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS v FROM c),
l AS (SELECT DISTINCT host FROM d WHERE host != '' AND substr(sha256(host), 1, 1) IN ('0', '1'))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END) AS verdict, host IN (SELECT host FROM l) AS listed FROM d
"""
