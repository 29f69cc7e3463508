"""Command line: crawl a seed list, or extract the tables of article lines.

    spark-submit -m weftable.cli crawl --seed SEEDS --out DIR
    spark-submit -m weftable.cli extract --in LINES --out DIR [--mode corrected] [--ascii]

The established spelling works too: -option crawl_table_articles -seed SEEDS -out DIR, and
-option parse_tables -in LINES -out DIR; an unknown option is an error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftable.operators.extract import extract
from weftable.operators.relational import errors
from weftable.sources import readers, writers
from weftable.sources.crawler import crawl


#: Established names of the sub-commands. Fixed values.
OPTIONS = {"crawl_table_articles": "crawl", "parse_tables": "extract"}


def renamed(argv: list[str]) -> list[str]:
    """Arguments in the established spelling as those of the sub-commands; others as they are."""
    if "-option" not in argv[:-1]:
        return argv
    at = argv.index("-option")
    rest = [f"-{a}" if a in ("-seed", "-in", "-out") else a for a in argv[:at] + argv[at + 2 :]]
    return [OPTIONS.get(argv[at + 1], argv[at + 1]), *rest]


def main(argv: list[str] | None = None) -> None:
    argv = renamed(sys.argv[1:] if argv is None else argv)
    p = argparse.ArgumentParser(prog="weftable")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("crawl")
    a.add_argument("--seed", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--partitions", type=int, default=8)
    a.add_argument("--tries", type=int, default=3)
    b = sub.add_parser("extract")
    b.add_argument("--in", dest="source", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--mode", choices=("reference", "corrected"), default="reference")
    b.add_argument("--ascii", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("weftable").getOrCreate()
    if args.what == "crawl":
        got = crawl(readers.seeds(spark, args.seed), partitions=args.partitions, tries=args.tries)
        got.write.mode("overwrite").parquet(f"{args.out}/fetched")
        got = spark.read.parquet(f"{args.out}/fetched")
        writers.write_crawl(got.filter("ok"), f"{args.out}/articles", html="body")
        got.filter(~F.col("ok")).select("entity", "url", "error").write.mode("overwrite").json(f"{args.out}/failed")
    else:
        lines = readers.read_articles(spark, args.source).withColumn("line", F.monotonically_increasing_id())
        extract(lines, "html", args.mode).write.mode("overwrite").parquet(f"{args.out}/extracted")  # parsed once
        got = writers.with_article_ids(spark.read.parquet(f"{args.out}/extracted"), "line")
        writers.write_article_json(got, f"{args.out}/articles", args.ascii)
        writers.write_errors(errors(got, "line"), f"{args.out}/errors")


if __name__ == "__main__":
    main()
