"""Experiment grids: expansion with family rules, row identities, coverage, stages."""

from __future__ import annotations

import hashlib
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.collections import canonical_json


def expand(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """The product of small axes as rows; each row's id is the SHA-256 of its values."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], f"{name} {'string' if isinstance(values[0], str) else 'bigint' if isinstance(values[0], int) else 'double'}")
        out = axis if out is None else out.crossJoin(F.broadcast(axis))
    return with_row_id(out, *axes)


def with_row_id(rows: DataFrame, *columns: str) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return rows.withColumn("row_id", F.sha2(F.concat_ws("|", *parts), 256))


def united(families: list[DataFrame]) -> DataFrame:
    """Families of rows as one, a row id once."""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["row_id"])


def missing(planned: DataFrame, completed: DataFrame, *key: str) -> DataFrame:
    return planned.join(completed.select(*key).distinct(), list(key), "left_anti")


def coverage(planned: DataFrame, completed: DataFrame, family: str, *key: str) -> DataFrame:
    """Per family: rows planned, missing."""
    gone = missing(planned, completed, *key).groupBy(family).agg(F.count("*").alias("missing"))
    return planned.groupBy(family).agg(F.count("*").alias("planned")).join(gone, family, "left").select(family, "planned", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))


#: The families of the experiment grid, and what a family takes where the configuration doesn't say.
FAMILIES = ("primary", "sparsity", "robustness", "parameters", "controls", "shared_sae")
DEFAULTS = {"robustness_seeds": [1, 2], "k1": [0.6, 1.2, 2.4], "b": [0, 0.5, 0.75], "controls": ["shuffled_idf"]}


def family(config: dict, name: str) -> list[dict]:
    """The cells of one family, or of ``all``, each cell once: a plan of some thousand rows, made on the driver.

    Every enabled collection to evaluate on is crossed with bases, granularities, seeds, budgets, parameters and controls.  Three families take only the
    collections listed for them; robustness only the listed bases, and other seeds; shared_sae only secondary bases, which the others leave out; sparsity all
    budgets, the others primary ones.
    """
    if name == "all":
        return list({c["row_id"]: c for f in FAMILIES for c in family(config, f)}.values())
    if name not in FAMILIES:
        raise ValueError(f"no such family: {name}")
    given = DEFAULTS | config.get("experiments", {})
    chosen = {"robustness": "robustness_collections", "parameters": "parameter_collections", "controls": "control_collections"}.get(name)
    collections = {n: d for n, d in config["datasets"].items() if d["role"] == "evaluate" and d.get("enabled", True) and (chosen is None or n in given.get(chosen, []))}
    named = [b["name"] for b in config["bases"] if bool(b.get("secondary")) == (name == "shared_sae") and (name != "robustness" or b["name"] in given.get("stochastic_bases", []))]
    axes = {
        "granularity": config.get("granularities", ["pooled", "token"]),
        "seed": given["robustness_seeds"] if name == "robustness" else [0],
        "budget": [b for b in config["budgets"] if b.get("primary") or name == "sparsity"],
        "k1": given["k1"] if name == "parameters" else [1.2],
        "b": given["b"] if name == "parameters" else [0.75],
        "control": given["controls"] if name == "controls" else [None],
    }
    cells = []
    for collection, basis, *rest in product(collections, named, *axes.values()):
        cell = {"collection": collection, "corpus_id": collections[collection]["corpus_id"], "basis": basis, **dict(zip(axes, rest, strict=True))}
        if not cell["budget"].get("collections") or collection in cell["budget"]["collections"]:
            cell["budget"] = cell["budget"]["name"]
            cells.append(cell | {"row_id": hashlib.sha256(canonical_json(cell).encode()).hexdigest()})
    return cells
