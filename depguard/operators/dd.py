"""Differential dependencies: pairs whose left distances all hold and of whose right distances one doesn't.

A null distance holds nowhere on the left and violates nothing on the right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depguard.plans.pairs import COMPARE, bucket_join, distance_grid, grid_join, sides
from depguard.report import as_count, pairs_of, wide
from depguard.rules import DD, Dist
from depguard.rules.model import NEGATE
from depguard.session import Scratch


def _distance(d: Dist, negate: bool = False) -> Column:
    a, b = (F.col(f"{s}_{d.column}") for s in "AB")
    return COMPARE[NEGATE[d.op] if negate else d.op](F.abs(a - b), F.lit(d.bound))


def _numbers(df: DataFrame, cols: list[str], key: str | None) -> DataFrame:
    """The columns, those of strings read as numbers, what isn't one as null."""
    kinds = dict(df.dtypes)
    return df.select(*(F.col(c).try_cast("double").alias(c) if kinds[c] == "string" and c != key else F.col(c) for c in cols))


def _columns(dd: DD) -> list[str]:
    return list(dict.fromkeys(d.column for d in (*dd.lhs, *dd.rhs)))


def _conditions(dd: DD) -> Column:
    on, bad = F.lit(True), F.lit(False)
    for d in dd.lhs:
        on = on & _distance(d)
    for d in dd.rhs:
        bad = bad | _distance(d, negate=True)
    return on & bad


def _most_selective(df: DataFrame, distances: list[Dist]) -> Dist:
    """Of distances with an upper bound, that whose bound is the smallest part of its column's spread; of distances with a
    lower one, the largest."""
    if len(distances) == 1:
        return distances[0]
    spread = df.agg(*(F.coalesce((F.max(d.column) - F.min(d.column)).cast("double"), F.lit(0.0)).alias(f"s{i}") for i, d in enumerate(distances))).first()
    part = lambda x: x[1].bound / (spread[x[0]] or 1e-300)
    return (max if distances[0].op[0] == ">" else min)(enumerate(distances), key=part)[1]


def _meet(df: DataFrame, cols: list[str], dd: DD, key: str, first: Column, strategy: str, grid: int | None) -> DataFrame:
    a, b = sides(df, cols)
    on = first & _conditions(dd)
    bounded, far = ([d for d in dd.lhs if d.op in ops] for ops in (("<", "<=", "="), (">", ">=", "=")))
    if not bounded and not far:
        return grid_join(a, b, f"A_{key}", f"B_{key}", grid, on)
    if strategy == "grid" or not bounded:
        x = _most_selective(df, bounded or far).column
        low, high = (max((d.bound for d in far if d.column == x), default=None), min((d.bound for d in bounded if d.column == x), default=None))
        return distance_grid(df, cols, x, low, high, key, _conditions(dd), grid, Scratch(df.sparkSession))
    best = _most_selective(df, bounded)
    return bucket_join(a, b, f"A_{best.column}", f"B_{best.column}", best.bound, f"A_{key}", on, Scratch(df.sparkSession))


def dd_pairs(df: DataFrame, dd: DD, key: str, strategy: str = "auto", grid: int | None = None) -> DataFrame:
    """Unordered pairs, A's key the smaller: A_x, B_x of the key and the rule's columns.

    String columns are read as numbers, what isn't one as null. strategy: bucket joins neighbouring buckets of the left
    distance that prunes most (its bound is the smallest part of its column's spread); grid meets pairs in cells of its
    ranges, but for cells that its bounds rule out, needed only if no left distance has an upper bound; auto takes the
    first that applies. Only left distances that all are != compare all pairs.
    """
    cols = list(dict.fromkeys([key, *_columns(dd)]))
    return _meet(_numbers(df, cols, key), cols, dd, key, F.col(f"A_{key}") < F.col(f"B_{key}"), strategy, grid)


def dd_report(df: DataFrame, dd: DD, key: str | None = None, strategy: str = "auto", grid: int | None = None, exact: bool = False) -> DataFrame:
    """dirty = violating unordered pairs, total = n(n-1)/2.

    Rows equal on the rule's columns are one class with a weight; only classes are joined, and a pair of classes counts
    as the product of their weights. Within a class all distances are 0. `exact`: decimals, beyond 2^63-1 too.
    """
    cols = _columns(dd)
    classes = Scratch(df.sparkSession).write(_numbers(df, cols, None).groupBy(*cols).agg(F.count("*").alias("__w")), "classes").withColumn("__k", F.struct(*cols))
    met = _meet(classes, [*cols, "__w", "__k"], dd, "__k", F.col("A___k") < F.col("B___k"), strategy, grid)
    at_zero = lambda d, negate: COMPARE[NEGATE[d.op] if negate else d.op](F.col(d.column) - F.col(d.column), F.lit(d.bound))
    zero, bad = F.lit(True), F.lit(False)
    for d in dd.lhs:
        zero = zero & at_zero(d, False)
    for d in dd.rhs:
        bad = bad | at_zero(d, True)
    counts = met.select((wide(F.col("A___w")) * wide(F.col("B___w"))).cast("decimal(38,0)").alias("u")).unionByName(classes.filter(zero & bad).select(pairs_of(F.col("__w")).cast("decimal(38,0)").alias("u")))
    n = df.agg(F.count("*").alias("n"))
    return counts.agg(F.sum("u").alias("u")).join(F.broadcast(n)).select(as_count(F.col("u"), exact).alias("dirty"), as_count(pairs_of(F.col("n")), exact).alias("total"), F.lit(str(dd)).alias("rule"))
