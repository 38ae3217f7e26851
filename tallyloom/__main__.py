"""Command line: python -m tallyloom {list, sql, run, prepare, index, evaluate, controls}."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries")
    sub.add_parser("sql", help="a query's SQL").add_argument("query")
    run = sub.add_parser("run", help="a query over a folder of tables, written as Parquet")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("out")
    prepare = sub.add_parser("prepare", help="check and store a collection")
    for name in ("documents", "queries", "qrels", "out"):
        prepare.add_argument(name)
    prepare.add_argument("--expected-documents", type=int)
    prepare.add_argument("--expected-queries", type=int)
    index = sub.add_parser("index", help="index a stored collection")
    index.add_argument("collection")
    index.add_argument("--budget", type=int)
    evaluate = sub.add_parser("evaluate", help="rank and evaluate an indexed collection under the eight settings")
    evaluate.add_argument("collection")
    evaluate.add_argument("--k", type=int, default=1000)
    evaluate.add_argument("--exclude-identical-ids", action="store_true")
    sub.add_parser("controls", help="the algebra that the scorer has to obey")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from tallyloom import catalog
    from tallyloom.plans import dataset
    from tallyloom.sources.collections import markdown

    if args.command == "list":
        print("\n".join(catalog.QUERIES))
        return 0
    if args.command == "sql":
        print(catalog.ORACLES[args.query])
        return 0
    spark = SparkSession.builder.appName("tallyloom").getOrCreate()
    if args.command == "run":
        catalog.QUERIES[args.query](spark, args.tables).write.mode("overwrite").parquet(args.out)
    elif args.command == "prepare":
        dataset.prepare(spark, args.documents, args.queries, args.qrels, args.out, expected_documents=args.expected_documents, expected_queries=args.expected_queries)
    elif args.command == "index":
        dataset.index(spark.read.parquet(f"{args.collection}/documents"), f"{args.collection}/index", args.budget)
    elif args.command == "evaluate":
        at = args.collection
        indexed = {name: spark.read.parquet(f"{at}/index/{name}") for name in ("postings", "items")}
        got = dataset.evaluate(indexed, spark.read.parquet(f"{at}/queries"), spark.read.parquet(f"{at}/qrels"), k=args.k, exclude_self=args.exclude_identical_ids)
        for name, df in got.items():
            df.write.mode("overwrite").parquet(f"{at}/evaluation/{name}")
        print(markdown(spark.read.parquet(f"{at}/evaluation/means").orderBy("config")))
    else:
        error = dataset.algebra_error(spark)
        print(f"largest deviation: {error:.3g}")
        return int(error > 1e-12)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
