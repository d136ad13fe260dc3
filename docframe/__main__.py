"""Command line: lists the registered queries, or runs one over a folder of tables.

    python -m docframe queries
    python -m docframe run NAME FOLDER [--to PATH] [--rows N]
    python -m docframe sql NAME

Ends with 0 if all went well, 1 if the query failed, 2 if there is no such query.
"""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    from docframe.plans import catalog

    parser = argparse.ArgumentParser(prog="docframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of all queries")
    sql = commands.add_parser("sql", help="the SQL of a query")
    run = commands.add_parser("run", help="run a query")
    for command in (sql, run):
        command.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--to", help="write the result there as Parquet")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    told = parser.parse_args(args)
    if told.command == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if told.name not in (catalog.ORACLES if told.command == "sql" else catalog.QUERIES):
        print(f"no query {told.name!r}", file=sys.stderr)
        return 2
    if told.command == "sql":
        print(catalog.ORACLES[told.name])
        return 0
    from pyspark.sql import SparkSession

    from docframe.session import ship

    spark = SparkSession.builder.appName("docframe").getOrCreate()
    ship(spark)
    try:
        found = catalog.QUERIES[told.name](spark, told.folder)
        if told.to:
            found.write.parquet(told.to)
        else:
            found.show(told.rows, truncate=80)
    except Exception as e:  # noqa: BLE001 - the command's result is its exit code
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
