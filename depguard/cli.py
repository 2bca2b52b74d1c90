"""python -m depguard.cli detect|repair TABLE FAMILY RULE [--key K] [--output O] [--target T] [--header H] [--numeric C,..] [--base B]"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession, functions as F

from depguard.api import detect, repair
from depguard.rules import parse_rule
from depguard.sources import read_table, read_text_with_header, write_repaired, write_report


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="depguard", description=__doc__)
    ap.add_argument("task", choices=["detect", "repair"])
    ap.add_argument("table", help="catalog table, parquet path, or text path with --header")
    ap.add_argument("family", choices=["fd", "mfd", "fdset", "dc", "dd", "pod"])
    ap.add_argument("rule")
    ap.add_argument("--key")
    ap.add_argument("--output", default="report")
    ap.add_argument("--vote", default="plurality", choices=["plurality", "majority"])
    ap.add_argument("--target", help="path or table for the result; else it is shown")
    ap.add_argument("--header", help="column names of a delimited text without a header row")
    ap.add_argument("--numeric", help="columns of text that a constraint compares as numbers, separated by commas")
    ap.add_argument("--base", help="the base that an order dependency checks the table against; read like the table")
    a = ap.parse_args(argv)
    spark = spark or SparkSession.builder.appName("depguard").getOrCreate()
    began = time.time()
    read = lambda name: read_text_with_header(spark, name, a.header) if a.header else read_table(spark, name)
    df, rule = read(a.table), parse_rule(a.rule, a.family)
    options = {"numeric": frozenset(c.strip() for c in a.numeric.split(","))} if a.numeric else {}
    if a.family == "pod":
        numbers = lambda x: x.withColumns({c: F.col(c).try_cast("double") for c in (*(c for c, _ in rule.lhs), rule.rhs[0])}) if a.header else x
        df = numbers(df)
        options = {"base": numbers(read(a.base))} if a.base else {}
    if a.task == "detect":
        out = detect(df, rule, a.key, a.output, **options)
        write_report(out, a.target) if a.target else out.show(truncate=False)
    else:
        done = repair(df, rule, kind=a.vote)
        if a.target:
            write_repaired(done.df, a.target)
        done.report().show(truncate=False)
        if done.unrepaired:
            print("not repaired (cycle):", ", ".join(done.unrepaired))
    print(f"done in {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
