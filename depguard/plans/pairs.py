"""Joins of pairs of rows by comparisons that aren't equalities.

Catalyst plans `abs(a-b) < n` and `a > b` as a nested loop over all pairs. Here a distance becomes an equality on
neighbouring buckets; what has no bound at all is met in the cells of a triangular grid, each pair in exactly one cell.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, functions as F

from depguard.plans.skew import fragment_join, hot_cuts
from depguard.session import Scratch

COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def sides(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    cols = list(dict.fromkeys(cols))
    return df.select(*(F.col(c).alias(f"A_{c}") for c in cols)), df.select(*(F.col(c).alias(f"B_{c}") for c in cols))


def bucket_join(a: DataFrame, b: DataFrame, x: str, y: str, width: float, key_a: str, on: Column, scratch: Scratch) -> DataFrame:
    """Pairs with |x - y| <= width, and `on`. x is of a, y of b.

    Buckets are wider than the bound by a billionth, so rounding never loses a pair; `on` decides exactly. Buckets that make
    a large part of the comparisons are cut into pieces by load.
    """
    w = F.lit(float(width) * (1 + 1e-9) if width > 0 else 1.0)
    bucket = lambda c: F.floor(F.col(c).cast("double") / w)
    near = lambda c: F.explode(F.sequence(c - 1, c + 1))
    left = a.filter(F.col(x).isNotNull()).withColumn("_bk", bucket(x))
    right = b.filter(F.col(y).isNotNull()).withColumn("_bk", near(bucket(y)))
    met = b.filter(F.col(y).isNotNull()).groupBy(bucket(y).alias("_at")).agg(F.count("*").alias("_n")).select(near(F.col("_at")).alias("_bk"), "_n")
    loads = left.groupBy("_bk").agg(F.count("*").cast("double").alias("_m")).join(met.groupBy("_bk").agg(F.sum("_n").alias("_n")), "_bk")
    loads = scratch.write(loads.select("_bk", (F.col("_m") * F.col("_n")).alias("_load")), "loads")
    cuts = hot_cuts(loads, ["_bk"], "_load", loads.agg(F.sum("_load")).first()[0] or 0)
    return fragment_join(left, right, ["_bk"], cuts, F.xxhash64(key_a), on).drop("_bk")


#: Rows of each side that meet in a cell of a grid, about.
CELL_ROWS = 20_000


def grid_side(a: DataFrame, b: DataFrame) -> int:
    """Lines of a grid for two tables: cells of about CELL_ROWS rows, and enough of them to keep all cores busy."""
    least = math.ceil(math.sqrt(3 * a.sparkSession.sparkContext.defaultParallelism))
    return max(least, -(-max(a.count(), b.count()) // CELL_ROWS))


def grid_join(a: DataFrame, b: DataFrame, key_a: str, key_b: str, side: int | None, on: Column) -> DataFrame:
    """All pairs that satisfy `on`, met in a square grid of side*side cells: a row of A goes to one line, a row of B to
    one column, by hash of its key. Every pair meets once; a cell holds 1/side of each side."""
    side = side or grid_side(a, b)
    left = a.withColumn("_r", F.pmod(F.xxhash64(key_a), F.lit(side))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    right = b.withColumn("_k", F.pmod(F.xxhash64(key_b), F.lit(side))).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    return left.join(right, (F.col("_r") == F.col("_q")) & (F.col("_c") == F.col("_k")) & on).drop("_r", "_c", "_k", "_q")


def order_join(a: DataFrame, b: DataFrame, x: str, op: str, y: str, key_a: str, key_b: str, side: int | None, on: Column, how: str = "inner") -> DataFrame:
    """Pairs with `x op y` (op one of < <= > >=; x is of a, y of b, both numbers) and `on`, met in a grid whose lines are
    ranges of x and whose columns are the same ranges of y.

    A cell whose ranges can't satisfy the comparison isn't filled, so half of the cells and copies fall away. A value that
    would fill several ranges is spread over them by hash of the key. how: inner or left_semi.
    """
    side = side or grid_side(a, b)
    a, b = a.filter(F.col(x).isNotNull()), b.filter(F.col(y).isNotNull())
    cuts = a.select(F.col(x).cast("double").alias("v")).approxQuantile("v", [i / side for i in range(1, side)], 0.2 / side) if side > 1 else []
    of = F.array(*map(F.lit, sorted(cuts))) if cuts else None

    def stripes(df: DataFrame, c: str, key: str, own: str) -> DataFrame:
        """own: the range of a value; _low and _high: the first and the last one it could have been put in."""
        if of is None:
            return df.withColumns({own: F.lit(0), "_low": F.lit(0), "_high": F.lit(0)})
        v = F.col(c).cast("double")
        df = df.withColumns({"_low": F.size(F.filter(of, lambda q: q < v)), "_high": F.size(F.filter(of, lambda q: q <= v))})
        return df.withColumn(own, (F.col("_low") + F.pmod(F.xxhash64(key), F.col("_high") - F.col("_low") + 1)).cast("int"))

    zero, last, low, high = F.lit(0), F.lit(len(cuts)), F.col("_low"), F.col("_high")
    left, right = stripes(a, x, key_a, "_r"), stripes(b, y, key_b, "_k")
    # Equal values may lie in different ranges of those they fill: they meet by the widest of these.
    down = op in (">", ">=")
    left = left.withColumn("_c", F.explode(F.sequence(zero, high) if down else F.sequence(low, last))).drop("_low", "_high")
    right = right.withColumn("_q", F.explode(F.sequence(low, last) if down else F.sequence(zero, high))).drop("_low", "_high")
    return left.join(right, (F.col("_r") == F.col("_q")) & (F.col("_c") == F.col("_k")) & on, how).drop("_r", "_c", "_k", "_q")


#: Rows of a line of `distance_grid` at least, if it has more than LINES[0] lines, and the bounds of their number.
LINE_ROWS, LINES = 500, (64, 500)


def distance_grid(df: DataFrame, cols: list[str], x: str, low: float | None, high: float | None, key: str, on: Column, side: int | None, scratch: Scratch) -> DataFrame:
    """Pairs of two rows of df, A's key the smaller, with low <= |A_x - B_x| <= high (None: no bound) and `on`, which decides
    exactly and must be the same both ways round: A_c, B_c of `cols`.

    Lines are ranges of x by quantiles, cells are two lines each. A pair meets in one cell, whichever of its rows is A, and
    cells whose lines are too near or too far apart aren't filled; nor is a row sent to a cell that it can't have a partner
    in. A value that would fill several lines is spread over them. Cells go to tasks by load.
    """
    spark = df.sparkSession
    df = df.select(*cols).filter(F.col(x).isNotNull() & F.col(key).isNotNull()).withColumn("__v", F.col(x).cast("double"))
    if side is None:
        n = df.count()
        side = min(LINES[1], max(math.ceil(math.sqrt(3 * spark.sparkContext.defaultParallelism)), -(-n // CELL_ROWS), min(LINES[0], -(-n // LINE_ROWS))))
    # NaN and infinity are no numbers to compute with: their line is the last one, and meets all.
    finite = ~F.isnan("__v") & (F.abs("__v") != float("inf"))
    cuts = df.filter(finite).approxQuantile("__v", [i / side for i in range(1, side)], 0.2 / side) if side > 1 else []
    of = F.array(*map(F.lit, sorted(cuts))) if cuts else F.array().cast("array<double>")
    first, last = F.size(F.filter(of, lambda q: q < F.col("__v"))), F.size(F.filter(of, lambda q: q <= F.col("__v")))
    line = F.when(finite, first + F.pmod(F.xxhash64(key), last - first + 1)).otherwise(len(cuts) + 1).cast("int")
    df = scratch.write(df.withColumn("__l", line), "lines")
    lines = [tuple(r) for r in df.groupBy("__l").agg(F.min("__v"), F.max("__v"), F.count("*")).orderBy("__l").collect()]

    def can_meet(lo_a, hi_a, lo_b, hi_b, most, absolute):
        """Of two ranges, a not above b but for equal values. Bounds are a billionth wider, as rounding must lose no pair."""
        slack = 1e-9 * (absolute(lo_a) + absolute(hi_a) + absolute(lo_b) + absolute(hi_b) + abs(low or 0) + abs(high or 0))
        near = [lo_b - hi_a <= high + slack, lo_a - hi_b <= high + slack] if high is not None else []
        return near + ([most(hi_b - lo_a, hi_a - lo_b) >= low - slack] if low is not None else [])

    cells = []
    for i, (r, lo_r, hi_r, n_r) in enumerate(lines):
        for q, lo_q, hi_q, n_q in lines[i:]:
            if q > len(cuts) or all(can_meet(lo_r, hi_r, lo_q, hi_q, max, abs)):
                cells.append((r, q, lo_r, hi_r, lo_q, hi_q, float(n_r) * n_q))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    free = [(0.0, i) for i in range(parts)]
    placed = []
    for no, (*cell, load) in enumerate(sorted(cells, key=lambda c: (-c[-1], c[0], c[1]))):
        used, part = heapq.heappop(free)
        heapq.heappush(free, (used + load, part))
        placed.append((*cell, no, part))
    few = F.broadcast(spark.createDataFrame(placed, "__r int, __q int, __lo_r double, __hi_r double, __lo_q double, __hi_q double, __cell int, __part int"))

    def sent(side: str, own: str, other: str) -> DataFrame:
        v, lo, hi = F.col("__v"), F.col(f"__lo_{other}"), F.col(f"__hi_{other}")
        all_meet, terms = F.lit(True), can_meet(v, v, lo, hi, F.greatest, F.abs)
        for term in terms:
            all_meet = all_meet & term
        met = df.join(few, F.col("__l") == F.col(f"__{own}")).filter(all_meet | (F.col("__q") > len(cuts)))
        apart = [(F.col("__r") < F.col("__q")).alias("__apart")] if side == "A" else []
        return met.select(*(F.col(c).alias(f"{side}_{c}") for c in cols), F.col("__cell").alias(f"__cell_{side}"), F.col("__part").alias(f"__part_{side}"), *apart).repartitionById(parts, f"__part_{side}")

    a, b = F.col(f"A_{key}"), F.col(f"B_{key}")
    same = (F.col("__part_A") == F.col("__part_B")) & (F.col("__cell_A") == F.col("__cell_B"))
    met = sent("A", "r", "q").join(sent("B", "q", "r").hint("merge"), same & ((a < b) | F.col("__apart") & (a > b)) & on)
    return met.select(*(F.when(a < b, F.col(f"{s}_{c}")).otherwise(F.col(f"{t}_{c}")).alias(f"{s}_{c}") for s, t in ("AB", "BA") for c in cols))
