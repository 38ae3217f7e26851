"""Lexical scoring document by document: no pair of a query and a document is exchanged or kept, only each task's tops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numeric import CONFIGS, K1, B
from tallyloom.operators.blocks import Best, bounded, loaded, top_of_block

#: Queries that a task ranks at once, documents that it scores at once, and features that it counts before it hands them on.
ASKED, SCORED, COUNTED = 100, 128, 300_000


def _tokens(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens of a batch (item, tokens), each one's row, and the rows' numbers of tokens."""
    column = batch.column(1)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return column.flatten(), np.repeat(np.arange(batch.num_rows), sizes), sizes


def feature_stats(documents: DataFrame) -> DataFrame:
    """(item, tokens), each item once -> feature, df, mass.  Tasks count the features of whole documents, so no posting is exchanged."""
    bounded(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            flat, row, _ = _tokens(batch)
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            code, n = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
            df = np.bincount(np.unique(row * n + code) % n, minlength=n)
            held.append(pa.table({"feature": coded.dictionary.cast(pa.string()), "df": df.astype(np.int64), "mass": np.bincount(code, minlength=n).astype(float)}))
            rows += n
            if rows > COUNTED:
                one = pa.concat_tables(held).group_by("feature").aggregate([("df", "sum"), ("mass", "sum")]).select(["feature", "df_sum", "mass_sum"]).rename_columns(["feature", "df", "mass"])
                held, rows = [one], one.num_rows
                if rows > COUNTED // 2:
                    yield from one.combine_chunks().to_batches(10_000)
                    held, rows = [], 0
        for one in held:
            yield from one.combine_chunks().to_batches(10_000)

    parts = documents.select("item", "tokens").mapInArrow(run, "feature string, df bigint, mass double")
    return parts.groupBy("feature").agg(F.sum("df").alias("df"), F.sum("mass").alias("mass"))


def asked_terms(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(item, tokens), each item once -> item, length, terms, counts: how often it has which of the vocabulary's terms, by their places."""
    spark = documents.sparkSession
    bounded(spark)
    sent, v = spark.sparkContext.broadcast(vocabulary), max(len(vocabulary), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(loaded(sent), pa.string())
        for batch in batches:
            flat, row, sizes = _tokens(batch)
            place = pc.index_in(flat.cast(pa.string()), value_set=known)
            found = np.asarray(place.is_valid())
            key, n = np.unique(row[found] * v + np.asarray(place.drop_null()).astype(np.int64), return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * v), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % v, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(sizes.astype(float)), *lists], ["item", "length", "terms", "counts"])

    return documents.select("item", "tokens").mapInArrow(run, "item string, length double, terms array<int>, counts array<int>")


def term_stats(rows: DataFrame, vocabulary: list[str]) -> tuple[int, float, np.ndarray]:
    """Number of items, mean length (0 without items), and df of each term of the vocabulary, from ``asked_terms``."""
    r = rows.agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[t["t"]] = t["count"]
    return r.n, r.length / r.n if r.n else 0.0, df


def _scored(batches: Iterator[pa.RecordBatch], model: dict, k1: float):
    """Names, eight scores (setting, query, item) and matched terms (query, item) of a few documents at a time."""
    ends, asked, weight, idf, average, n = (model[x] for x in ("ends", "asked", "weight", "idf", "average", "n"))
    for batch in batches:
        for at in range(0, batch.num_rows, SCORED):
            part = batch.slice(at, SCORED)
            rows, sizes = part.num_rows, np.asarray(pc.list_value_length(part.column(2))).astype(np.int64)
            term, value = np.asarray(part.column(2).flatten()), np.asarray(part.column(3).flatten()).astype(float)
            relative = np.repeat((1 - B) + B * np.asarray(part.column(1)) / average if average > 0 else np.ones(rows), sizes)
            degree = ends[term + 1] - ends[term]
            pair = np.repeat(np.arange(len(term)), degree)
            of = np.arange(len(pair)) - np.repeat(np.cumsum(degree) - degree, degree) + ends[term][pair]
            cell = asked[of] * rows + np.repeat(np.arange(rows), sizes)[pair]
            sums = np.empty((len(CONFIGS), n * rows))
            for c, config in enumerate(CONFIGS):
                by = relative if config[2] == "1" else 1.0
                x = (k1 + 1) * value / (value + k1 * by) if config[1] == "1" else value / by
                x = x * idf[term] if config[0] == "1" else x
                sums[c] = np.bincount(cell, x[pair] * weight[of], n * rows)
            yield part.column(0), sums.reshape(len(CONFIGS), n, rows), np.bincount(cell, minlength=n * rows).reshape(n, rows)


def _models(query_features, vocabulary: list[str], n_items: int, average: float, df: np.ndarray) -> Iterator[tuple[list, dict]]:
    """Queries, ``ASKED`` at a time, and for each term which of them ask for it."""
    place = {t: i for i, t in enumerate(vocabulary)}
    by_query: dict = {}
    for r in query_features:
        by_query.setdefault(r["query"], {}).setdefault(place[r["feature"]], r["value"])
    names = sorted(by_query, key=lambda q: (q is None, q))
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    for at in range(0, len(names), ASKED):
        some = names[at : at + ASKED]
        rows = sorted((t, q, w) for q, name in enumerate(some) for t, w in by_query[name].items())
        term = np.array([t for t, _, _ in rows], np.int64)
        yield some, {
            "ends": np.searchsorted(term, np.arange(len(vocabulary) + 1)), "asked": np.array([q for _, q, _ in rows], np.int64), "weight": np.array([w for _, _, w in rows], float), "idf": idf, "average": average, "n": len(some),
        }


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in no more partitions than keep the cores busy: each hands on its own tops."""
    return rows.coalesce(max(2 * rows.sparkSession.sparkContext.defaultParallelism, 8))


def _together(rows: DataFrame, schema: str, parts: list[DataFrame]) -> DataFrame:
    out = parts[0] if parts else rows.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: One task's tops of one query, as they are exchanged: the setting's place in ``CONFIGS``, item, score.
_TOPS = pa.schema([("config", pa.int8()), ("item", pa.string()), ("score", pa.float64())])


def best(rows: DataFrame, query_features: list, vocabulary: list[str], known: tuple[int, float, np.ndarray], k: int, k1: float = K1) -> DataFrame:
    """query, config, item, score, rank: the k best matches of every query under each setting, over the items of ``asked_terms``.

    A task hands on one row a query, with the tops of all settings; these are merged query by query, so no row for each of them is exchanged or sorted.
    """
    bounded(rows.sparkSession)
    schema, parts = "query string, tops binary", []

    def ranking(names, model):
        sent = rows.sparkSession.sparkContext.broadcast((names, model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, model = loaded(sent)
            n, tops = len(names), Best(len(CONFIGS) * len(names), k)
            for items, score, matched in _scored(batches, model, k1):
                top_of_block(tops, np.array(items.to_pylist(), object), score.reshape(-1, len(items)), np.tile(matched > 0, (len(CONFIGS), 1)))
            group, item, score = tops.result()
            ends = np.searchsorted(group, np.arange(len(CONFIGS) * n + 1))
            for q in range(n):
                own = [slice(ends[c * n + q], ends[c * n + q + 1]) for c in range(len(CONFIGS))]
                config = np.repeat(np.arange(len(CONFIGS), dtype=np.int8), [x.stop - x.start for x in own])
                if len(config):
                    packed = pa.record_batch([config, pa.array(np.concatenate([item[x] for x in own]), pa.string()), np.concatenate([score[x] for x in own])], schema=_TOPS)
                    yield pa.RecordBatch.from_arrays([pa.array([names[q]], pa.string()), pa.array([packed.serialize().to_pybytes()], pa.binary())], ["query", "tops"])

        return run

    for names, model in _models(query_features, vocabulary, *known):
        parts.append(_dealt(rows).mapInArrow(ranking(names, model), schema))
    return _together(rows, schema, parts).groupBy("query").applyInArrow(_merge(k), "query string, config string, item string, score double, rank int")


def _merge(k: int):
    def run(tops: pa.Table) -> pa.Table:
        rows = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(x.as_py()), _TOPS) for x in tops["tops"]])
        config, score = np.asarray(rows["config"]), np.asarray(rows["score"])
        places, ranks = [], []
        for c in range(len(CONFIGS)):
            own = np.flatnonzero(config == c)
            if len(own) > k:
                own = own[score[own] >= np.partition(score[own], -k)[-k] - 2e-9]
            names = np.array(rows["item"].take(pa.array(own)).to_pylist(), object)
            by_name = np.array(sorted(range(len(own)), key=names.__getitem__), np.int64)
            own = own[by_name][np.argsort(-np.round(score[own[by_name]], 9), kind="stable")][:k]
            places.append(own)
            ranks.append(np.arange(1, len(own) + 1, dtype=np.int32))
        at = np.concatenate(places)
        query, name = pa.array([tops["query"][0].as_py()] * len(at), pa.string()), pa.array(np.array(CONFIGS, object)[config[at]], pa.string())
        return pa.Table.from_arrays([query, name, rows["item"].take(pa.array(at)).combine_chunks(), pa.array(score[at]), pa.array(np.concatenate(ranks))], ["query", "config", "item", "score", "rank"])

    return run


def visits(rows: DataFrame, query_features: list, vocabulary: list[str], known: tuple[int, float, np.ndarray]) -> DataFrame:
    """query, matched_items, posting_visits, of queries that match any."""
    bounded(rows.sparkSession)
    schema, parts = "query string, matched_items bigint, posting_visits bigint", []

    def counting(names, model):
        sent = rows.sparkSession.sparkContext.broadcast((names, model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, model = loaded(sent)
            items, seen = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            for _, _, matched in _scored(batches, model, K1):
                items += (matched > 0).sum(axis=1)
                seen += matched.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(items), pa.array(seen)], ["query", "matched_items", "posting_visits"])

        return run

    for names, model in _models(query_features, vocabulary, *known):
        parts.append(_dealt(rows).mapInArrow(counting(names, model), schema))
    return _together(rows, schema, parts).groupBy("query").agg(F.sum("matched_items").alias("matched_items"), F.sum("posting_visits").alias("posting_visits")).where("matched_items > 0")


def holding(documents: DataFrame, passages: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, text) and passages of (query, text) -> query, doc_id of documents that hold a passage, character by character.

    A document that holds a passage has all its words but the outer two; only documents with the longest of these are searched for the passage itself.
    Passages of fewer than three words are looked for in all documents.
    """
    bounded(documents.sparkSession)
    by_word: dict = {}
    for query, passage in passages:
        by_word.setdefault(max(passage.split()[1:-1], key=len, default=None), []).append((query, passage))
    sent = documents.sparkSession.sparkContext.broadcast(by_word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = loaded(sent)
        words = by_word.keys()
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in (words & set(text.split())) | (words & {None}):
                    found += [(query, doc_id) for query, passage in by_word[word] if passage in text]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.string()), pa.array([i for _, i in found], batch.column(0).type)], ["query", "doc_id"])

    return documents.select("doc_id", "text").where("text is not null").mapInArrow(run, f"query string, doc_id {dict(documents.dtypes)['doc_id']}")
