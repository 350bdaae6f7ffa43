"""python -m docweave list | doctor | run QUERY SF_DIR OUT: the queries, what is there of the optional parts, one query to Parquet."""

from __future__ import annotations

import argparse
import importlib.util
import shutil
import sys

from docweave.plans import catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    commands.add_parser("doctor")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(catalog.QUERIES))
    run.add_argument("sf_dir")
    run.add_argument("out")
    asked = parser.parse_args(argv)
    if asked.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
    elif asked.command == "doctor":
        print("java", "found" if shutil.which("java") else "missing")
        for name in ("pyspark", "pyarrow", "pandas", "pymupdf"):
            print(name, "found" if importlib.util.find_spec(name) else "missing")
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("docweave").getOrCreate()
        catalog.QUERIES[asked.query](spark, asked.sf_dir).write.mode("errorifexists").parquet(asked.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
