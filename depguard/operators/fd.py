"""Functional dependencies: detection by aggregation, never by a self join.

A null left value never violates; a null right value counts as one value of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depguard.plans.skew import fragment_join, hot_cuts, hot_join, hot_keys
from depguard.report import as_count, pairs_of, report, wide
from depguard.rules import FD, MFD
from depguard.session import Scratch


def _present(cols: tuple[str, ...]):
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def value_counts(df: DataFrame, lhs: tuple[str, ...], rhs: str) -> DataFrame:
    """lhs.., rhs, __n: one row a combination, null values included."""
    return df.groupBy(*lhs, rhs).agg(F.count("*").alias("__n"))


def groups(df: DataFrame, fd: FD) -> DataFrame:
    """lhs.., n_values, n_rows of each left value with two or more right values."""
    return (
        value_counts(df.filter(_present(fd.lhs)), fd.lhs, fd.rhs)
        .groupBy(*fd.lhs)
        .agg(F.count("*").alias("n_values"), F.sum("__n").alias("n_rows"))
        .filter("n_values > 1")
    )


def _sizes(df: DataFrame, fd: FD, scratch: Scratch) -> DataFrame:
    """lhs.., __values, __rows of every left value, written: what tells violating from clean and hot from other values."""
    g = value_counts(df.filter(_present(fd.lhs)), fd.lhs, fd.rhs).groupBy(*fd.lhs)
    return scratch.write(g.agg(F.count("*").alias("__values"), F.sum("__n").alias("__rows")), "sizes")


def rows(df: DataFrame, fd: FD, scratch: Scratch | None = None) -> DataFrame:
    """All rows, with all columns, of violating groups. Rows of a left value that holds a large part of the table don't move
    (see plans.skew), be it violating or not."""
    lhs = list(fd.lhs)
    g = _sizes(df, fd, scratch or Scratch(df.sparkSession))
    hot = hot_keys(g, lhs, "__rows", g.agg(F.sum("__rows")).first()[0] or 0)
    return hot_join(df, g.filter("__values > 1").select(*lhs), lhs, hot, "left_semi").select(*df.columns)


def fd_report(df: DataFrame, fd: FD) -> DataFrame:
    """dirty = rows of violating groups, total = rows. Two hash aggregates, no join."""
    g = value_counts(df, fd.lhs, fd.rhs).groupBy(*fd.lhs).agg(F.count("*").alias("__v"), F.sum("__n").alias("__n"))
    return report(g, F.sum(F.when(_present(fd.lhs) & (F.col("__v") > 1), F.col("__n"))), F.sum("__n"), fd)


def rows_with_report(df: DataFrame, fd: FD) -> DataFrame:
    """Each violating row with dirty, total and rule; the report is one row, attached as scalar."""
    return rows(df, fd).join(F.broadcast(fd_report(df, fd)))


def before_after(before: DataFrame, after: DataFrame, fd: FD) -> DataFrame:
    """dirty_before, dirty_after, total, rule: the same rule before and after a repair; one row each side."""
    b = fd_report(before, fd).withColumnRenamed("dirty", "dirty_before")
    a = fd_report(after, fd).select(F.col("dirty").alias("dirty_after"), "rule")
    return b.join(F.broadcast(a), "rule").select("dirty_before", "dirty_after", "total", "rule")


def rollup_counts(df: DataFrame, left: str, right: str) -> DataFrame:
    """left, right, count, gid for (l, r), (l) and (): gid is grouping_id, so a null value and a subtotal differ."""
    return df.rollup(left, right).agg(F.count("*").alias("count"), F.grouping_id().cast("int").alias("gid")).select(left, right, "count", "gid")


def mfd_report(df: DataFrame, rule: MFD, exact: bool = False) -> DataFrame:
    """Unordered pairs equal on all of lhs and different on rhs, of n(n-1)/2.

    No join: in a group of n rows whose values occur n_v times, (n*n - sum n_v*n_v)/2 pairs differ. Sums are decimal,
    so that groups of billions of rows don't overflow; `exact` returns them so. Null on either side never matches.
    """
    counted = value_counts(df, rule.lhs, rule.rhs)
    ok = _present((*rule.lhs, rule.rhs))
    g = counted.groupBy(*rule.lhs).agg(
        wide(F.sum(F.when(ok, F.col("__n")))).alias("__m"), F.sum(F.when(ok, wide(F.col("__n")) * wide(F.col("__n")))).alias("__q"), F.sum("__n").alias("__n")
    )
    out = g.agg(F.sum(F.col("__m") * F.col("__m") - F.col("__q")).alias("twice"), F.sum("__n").alias("__n"))
    return out.select(as_count(F.col("twice") / 2, exact).alias("dirty"), as_count(pairs_of(F.col("__n")), exact).alias("total"), F.lit(str(rule)).alias("rule"))


def mfd_pairs(df: DataFrame, rule: MFD, key: str, scratch: Scratch | None = None) -> DataFrame:
    """One row a violating unordered pair: A_x, B_x for the key and each column of the rule, A's key the smaller.

    The join is on lhs; a group of one right value yields nothing and is dropped before it. A group that makes a large part
    of all pairs is cut into pieces by load: its rows on one side are spread over them, those on the other copied to each.
    """
    cols = list(dict.fromkeys([key, *rule.lhs, rule.rhs]))
    present, lhs = df.select(*cols).filter(F.col(rule.rhs).isNotNull()), list(rule.lhs)
    g = _sizes(present, FD(rule.lhs, rule.rhs), scratch or Scratch(df.sparkSession)).withColumn("__load", F.col("__rows").cast("double") * F.col("__rows"))
    n = g.agg(F.sum("__rows")).first()[0] or 0
    bad = g.filter("__values > 1")
    part = hot_join(present, bad.select(*lhs), lhs, hot_keys(g, lhs, "__rows", n), "left_semi")
    keys = {c: f"__on{i}" for i, c in enumerate(lhs)}
    cuts = hot_cuts(bad.withColumnsRenamed(keys), list(keys.values()), "__load", bad.agg(F.sum("__load")).first()[0] or 0)
    a, b = (part.select(*(F.col(c).alias(k) for c, k in keys.items()), *(F.col(c).alias(f"{side}_{c}") for c in cols)) for side in "AB")
    on = (F.col(f"A_{key}") < F.col(f"B_{key}")) & (F.col(f"A_{rule.rhs}") != F.col(f"B_{rule.rhs}"))
    return fragment_join(a, b, list(keys.values()), cuts, F.xxhash64(f"A_{key}"), on).drop(*keys.values())
