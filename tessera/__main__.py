"""Command line: python -m tessera QUERY DATA OUT [--form parquet] [--mode errorifexists], or --list."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.plans.catalogue import QUERIES


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description="Runs a catalogued query over a folder of tables and writes its result.")
    parser.add_argument("query", nargs="?", choices=sorted(QUERIES), metavar="QUERY")
    parser.add_argument("data", nargs="?", help="folder with <table>.parquet")
    parser.add_argument("out", nargs="?", help="folder to write")
    parser.add_argument("--form", default="parquet", choices=["parquet", "json", "csv", "orc"])
    parser.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite", "append", "ignore"])
    parser.add_argument("--list", action="store_true", help="print the names of the queries")
    given = parser.parse_args(args)
    if given.list:
        print("\n".join(sorted(QUERIES)))
        return 0
    if not (given.query and given.data and given.out):
        parser.error("give a query, the folder of its tables and the folder to write")
    spark = SparkSession.builder.appName(f"tessera {given.query}").getOrCreate()
    QUERIES[given.query](spark, given.data).write.format(given.form).mode(given.mode).save(given.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
