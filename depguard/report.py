"""The report row (dirty, total, rule) every detector returns, and the arithmetic of pair counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LARGEST = 2**63 - 1


def report(df: DataFrame, dirty: Column, total: Column, rule) -> DataFrame:
    """One row from one global aggregate; both columns are bigint and 0 on an empty table."""
    return df.agg(
        F.coalesce(dirty, F.lit(0)).cast("bigint").alias("dirty"), F.coalesce(total, F.lit(0)).cast("bigint").alias("total")
    ).withColumn("rule", F.lit(str(rule)))


def wide(n: Column) -> Column:
    """A row count that may be multiplied by another one."""
    return n.cast("decimal(19,0)")


def as_count(n: Column, exact: bool = False) -> Column:
    """A count of pairs as bigint. Beyond 2^63-1 (pairs of more than four billion rows) it fails and says so; exact gives
    decimal(38,0), which holds the pairs of 10^19 rows."""
    n = F.coalesce(n, F.lit(0)).cast("decimal(38,0)")
    if exact:
        return n
    return F.when(n > F.lit(LARGEST).cast("decimal(38,0)"), F.raise_error(F.lit("more than 2^63-1 pairs: ask for exact=True")).cast("bigint")).otherwise(n.cast("bigint"))


def pairs_of(n: Column) -> Column:
    """n(n-1)/2."""
    return wide(n) * (wide(n) - 1) / 2


def clamped(ordered: Column, n: Column, exact: bool = False) -> list[Column]:
    """The display form that keeps small ratios visible: below one percent of n*n the ratio becomes 2 of 9,900 (0 if none)."""
    kind = "decimal(38,0)" if exact else "bigint"
    small = ordered < wide(n) * wide(n) * 0.01
    return [
        F.when(small, F.when(ordered == 0, 0).otherwise(2)).otherwise(as_count(ordered, exact)).cast(kind).alias("dirty"),
        F.when(small, 9900).otherwise(as_count(wide(n) * (wide(n) - 1), exact)).cast(kind).alias("total"),
    ]
