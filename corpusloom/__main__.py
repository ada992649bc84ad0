"""Command line: python -m corpusloom COMMAND. Runs and validates labs over a folder of tables, runs single queries, reports the environment."""

from __future__ import annotations

import argparse
import json
import sys

from corpusloom import catalog, labs

#: Commands that run and that validate a lab.
RUN = {"build-dataset": "dataset", "audit-quality": "quality", "build-version": "version", "run-compute": "compute", "profile-dataloader": "feed", "run-recovery": "recovery", "benchmark-storage": "storage", "run-data-ab": "comparison", "run-graduation": "graduation"}
VALIDATE = {"validate-dataset": "dataset", "validate-quality": "quality", "validate-version": "version", "validate-compute": "compute", "validate-dataloader": "feed", "validate-recovery": "recovery", "validate-storage": "storage", "validate-data-ab": "comparison", "validate-graduation": "graduation"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m corpusloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("environment")
    commands.add_parser("list")
    for name in (*RUN, *VALIDATE):
        c = commands.add_parser(name)
        c.add_argument("tables")
        c.add_argument("out")
    c = commands.add_parser("query")
    c.add_argument("name")
    c.add_argument("tables")
    c.add_argument("out")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "environment":
        print(json.dumps(labs.environment(), indent=1, sort_keys=True))
        return 0
    queries = catalog.queries()
    if args.command == "list":
        print("\n".join(queries))
        return 0
    from pyspark.sql import SparkSession

    from corpusloom.session import ship_code
    from corpusloom.sources.files import write_parquet

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_code(spark)
    if args.command == "query":
        write_parquet(queries[args.name](spark, args.tables), args.out)
        return 0
    try:
        if args.command in RUN:
            done = labs.run(spark, queries, RUN[args.command], args.tables, args.out)
        else:
            done = labs.validate(spark, queries, VALIDATE[args.command], args.tables, args.out)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    print(done["fingerprint"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
