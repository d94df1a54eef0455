"""Command line: list the series queries, or run some of them over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.queries import QUERIES

FORMATS = ("parquet", "csv", "json")


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="python -m orrery", description=__doc__)
    commands = made.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="write the results of queries, each to a folder of its own name")
    run.add_argument("tables", help="folder of the input tables")
    run.add_argument("out", help="folder that results are written to")
    run.add_argument("names", nargs="*", metavar="query", help="queries; all if none is named")
    run.add_argument("--skip", nargs="*", default=[], metavar="query", help="queries to leave out")
    run.add_argument("--format", choices=FORMATS, default="parquet")
    run.add_argument("--mode", choices=("error", "overwrite", "ignore"), default="error", help="what to do where a result is there already")
    return made


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    if given.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    names = [n for n in given.names or sorted(QUERIES) if n not in given.skip]
    if unknown := sorted(set(names) - set(QUERIES)):
        print(f"no such query: {', '.join(unknown)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("orrery").getOrCreate()
    for name in names:
        QUERIES[name](spark, given.tables).write.mode(given.mode).option("header", True).format(given.format).save(f"{given.out.rstrip('/')}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
