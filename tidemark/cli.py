"""python -m tidemark.cli convert|merge|optimize|inspect|history|bench"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.sources import formats
from tidemark.sources.table import Table


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("convert", help="read one format, write another")
    x.add_argument("source")
    x.add_argument("target")
    x.add_argument("--where", help="a SQL condition")
    x.add_argument("--profile", default="archive")
    x = sub.add_parser("merge", help="one dataset from several")
    x.add_argument("sources", nargs="+")
    x.add_argument("--to", required=True)
    x = sub.add_parser("optimize", help="cluster a table's files")
    x.add_argument("table")
    x.add_argument("--by", nargs="+", required=True)
    x.add_argument("--z-order", action="store_true")
    for name in ("inspect", "history"):
        sub.add_parser(name).add_argument("table")
    x = sub.add_parser("bench", help="write and scan a dataset with each profile")
    x.add_argument("source")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if a.command == "convert":
        df = formats.load(spark, a.source)
        formats.save(df.where(a.where) if a.where else df, a.target, profile=a.profile)
    elif a.command == "merge":
        formats.merge_files(spark, a.sources, a.to)
    elif a.command == "optimize":
        print(json.dumps(Table.open(spark, a.table).optimize(a.by, z=a.z_order)))
    elif a.command == "inspect":
        table = Table.open(spark, a.table)
        print(json.dumps(table.describe(), default=str))
        table.inspect().show(50, truncate=False)
    elif a.command == "history":
        Table.open(spark, a.table).history().orderBy("version").show(100, truncate=False)
    else:
        from tidemark.operators.profile import compression_stats

        df = formats.load(spark, a.source)
        began = time.time()
        df.select(F.sum(F.xxhash64("*"))).collect()
        print(json.dumps({"scan_s": round(time.time() - began, 3), "codecs": compression_stats(df)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
