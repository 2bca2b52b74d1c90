"""Denial constraints: rows or pairs of distinct rows that satisfy all predicates at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depguard.plans.dominance import count_ordered
from depguard.plans.pairs import COMPARE, grid_join, order_join, sides
from depguard.plans.skew import fragment_join, hot_cuts
from depguard.report import as_count, clamped, pairs_of, wide
from depguard.rules import DC, Lit, Pred, Ref
from depguard.session import Scratch


def _expr(p: Pred, names: dict[str, str], numeric: frozenset = frozenset()) -> Column:
    """The predicate as a column; names: the column prefix that stands for each alias."""

    def side(x: Ref | Lit) -> Column:
        if isinstance(x, Lit):
            return F.lit(x.value)
        c = F.col(names[x.alias] + x.column)
        return c.try_cast("double") if x.column in numeric else c

    return COMPARE[p.op](side(p.left), side(p.right))


def _all(preds, names: dict[str, str], numeric: frozenset = frozenset()) -> Column:
    out = F.lit(True)
    for p in preds:
        out = out & _expr(p, names, numeric)
    return out


NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
PAIR, SWAPPED = {"A": "A_", "B": "B_"}, {"A": "B_", "B": "A_"}


def _own(preds, both_sides: bool) -> list[Pred]:
    """With both_sides a predicate on one tuple holds for the other one too."""
    out = list(preds)
    if both_sides:
        flip = {"A": "B", "B": "A"}
        other = lambda x: Ref(flip[x.alias], x.column) if isinstance(x, Ref) else x
        out += [Pred(other(p.left), p.op, other(p.right)) for p in preds if len(p.aliases) == 1]
    return out


def _columns(dc: DC) -> list[str]:
    return list(dict.fromkeys(x.column for p in dc.preds for x in (p.left, p.right) if isinstance(x, Ref)))


def rows(df: DataFrame, dc: DC, numeric: frozenset = frozenset()) -> DataFrame:
    """A constraint on one tuple: the rows that satisfy all of it. Columns in `numeric` are compared as numbers."""
    return df.filter(_all(dc.preds, {"A": "", "B": ""}, numeric))


def pairs(df: DataFrame, dc: DC, key: str, both_sides: bool = False, self_pairs: bool = False, grid: int | None = None, numeric: frozenset = frozenset(), scratch: Scratch | None = None) -> DataFrame:
    """Ordered pairs: A_x, B_x of the key and of every column of the rule.

    Predicates on one tuple filter their own side before the join (both sides with `both_sides`). Equalities of columns
    become the join keys, the other predicates its residual; values that make a large part of the pairs are cut into
    pieces by load. With no equality the sides meet in the cells of a grid (of `grid` lines, else as the rows need): one
    of ranges if a comparison of numbers can rule cells out.
    """
    preds = _own(dc.preds, both_sides)
    a, b = sides(df, [key, *_columns(dc)])
    on = F.lit(True) if self_pairs else F.col(f"A_{key}") != F.col(f"B_{key}")
    return _meet(a, b, preds, on, f"A_{key}", f"B_{key}", grid, numeric, scratch)


def _flipped(p: Pred) -> Pred:
    flip = lambda x: Ref({"A": "B", "B": "A"}[x.alias], x.column) if isinstance(x, Ref) else x
    out = Pred(flip(p.left), p.op, flip(p.right))
    return out.mirrored() if len(p.aliases) == 2 else out


def pair_members(df: DataFrame, dc: DC, key: str, both_sides: bool = False, self_pairs: bool = False, grid: int | None = None, numeric: frozenset = frozenset(), scratch: Scratch | None = None) -> DataFrame:
    """The rows, with all columns, that are A or B of some violating pair. No pair is formed: each side is asked by a semi
    join whether it has a partner."""
    preds, scratch = _own(dc.preds, both_sides), scratch or Scratch(df.sparkSession)
    on = F.lit(True) if self_pairs else F.col(f"A_{key}") != F.col(f"B_{key}")
    found = None
    for own in (preds, [_flipped(p) for p in preds]):
        a, b = sides(df, [key, *_columns(dc)])
        part = _meet(a, b, own, on, f"A_{key}", f"B_{key}", grid, numeric, scratch, "left_semi").select(F.col(f"A_{key}").alias(key))
        found = part if found is None else found.union(part)
    return df.join(found.distinct(), key, "left_semi").select(*df.columns)


def _meet(a: DataFrame, b: DataFrame, preds: list[Pred], on: Column, key_a: str, key_b: str, grid: int | None, numeric: frozenset, scratch: Scratch | None, how: str = "inner") -> DataFrame:
    a = a.filter(_all([p for p in preds if p.aliases == {"A"}], PAIR, numeric))
    b = b.filter(_all([p for p in preds if p.aliases == {"B"}], PAIR, numeric))
    double = [p for p in preds if len(p.aliases) == 2]
    on = _all(double, PAIR, numeric) & on
    number = lambda p: p.op[0] in "<>" and all(x.column in numeric or kinds[f"A_{x.column}"] in NUMBERS or kinds[f"A_{x.column}"].startswith("decimal") for x in (p.left, p.right))
    kinds = dict(a.dtypes)
    if equal := [p for p in double if p.op == "="]:
        keys = [f"__on{i}" for i in range(len(equal))]
        value = lambda x, side: (F.col(side + x.column).try_cast("double") if x.column in numeric else F.col(side + x.column))
        a = a.select("*", *(value(p.left, "A_").alias(k) for p, k in zip(equal, keys)))
        b = b.select("*", *(value(p.right, "B_").alias(k) for p, k in zip(equal, keys)))
        na, nb = (x.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((a, "__a"), (b, "__b")))
        scratch = scratch or Scratch(a.sparkSession)
        loads = scratch.write(na.join(nb, keys).select(*keys, (F.col("__a").cast("double") * F.col("__b")).alias("__load")), "loads")
        cuts = hot_cuts(loads, keys, "__load", loads.agg(F.sum("__load")).first()[0] or 0)
        return fragment_join(a, b, keys, cuts, F.xxhash64(key_a), on, how).drop(*keys)
    if order := [p for p in double if number(p)]:
        p = order[0]
        cast = lambda df, c, x: df.withColumn(c, F.col(c).try_cast("double")) if x.column in numeric else df
        x, y = f"A_{p.left.column}", f"B_{p.right.column}"
        return order_join(cast(a, x, p.left), cast(b, y, p.right), x, p.op, y, key_a, key_b, grid, on, how)
    if how != "inner":
        return grid_join(a, b, key_a, key_b, grid, on).select(*a.columns).distinct()
    return grid_join(a, b, key_a, key_b, grid, on)


def _only_order(preds: list[Pred]) -> list[Pred] | None:
    """The predicates on two tuples, if they are one or two comparisons of order, each of a column with itself."""
    double = [p for p in preds if len(p.aliases) == 2]
    return double if 1 <= len(double) <= 2 and all(p.op[0] in "<>" and p.left.column == p.right.column for p in double) else None


def _ordered(classes: DataFrame, preds: list[Pred], order: list[Pred], numeric: frozenset, self_pairs: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """o and u of pairs of rows that differ in a compared column, and of pairs that are equal in all of them."""
    value = lambda p: F.col(p.left.column).try_cast("double") if p.left.column in numeric else F.col(p.left.column)
    of = lambda *sides: F.when(_all([p for p in preds if len(p.aliases) == 1 and p.aliases <= {*sides}], {"A": "", "B": ""}, numeric), F.col("__w")).otherwise(0)
    points = classes.select(value(order[0]).alias("__x"), value(order[-1]).alias("__y"), of("A").alias("__wa"), of("B").alias("__wb"), of("A", "B").alias("__wab"))
    points = points.filter("__x IS NOT NULL AND __y IS NOT NULL AND (__wa > 0 OR __wb > 0)")
    if {*classes.columns} != {*(p.left.column for p in order), "__w", "__k"} or numeric:
        points = points.groupBy("__x", "__y").agg(*(F.sum(c).alias(c) for c in ("__wa", "__wb", "__wab")))
        points = scratch.write(points, "points")
    # Of two such rows only one can be ahead in a compared column, so no pair violates both ways round.
    met = count_ordered(points, order[0].op, order[-1].op, scratch).select(F.col("n").alias("o"), F.col("n").alias("u"))
    both, ab = wide(F.col("__wa")) * wide(F.col("__wb")), wide(F.col("__wab"))
    same = points.filter(F.lit(all("=" in p.op for p in order))).select((both - (0 if self_pairs else ab)).alias("o"), (both - ab - pairs_of(F.col("__wab"))).alias("u"))
    return met, same


def dc_report(df: DataFrame, dc: DC, key: str | None = None, clamp: bool = False, both_sides: bool = False, self_pairs: bool = False, grid: int | None = None, numeric: frozenset = frozenset(), exact: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """dirty, total, ordered_pairs, rule.

    On one tuple: rows of all rows. On two: unordered pairs with a violating orientation, of n(n-1)/2; with `clamp` the
    ordered count over n(n-1) in display form. n is counted before predicates on one tuple apply.

    No pair of rows is formed: rows equal on the rule's columns are one class with a weight, classes are joined, and a
    pair of classes counts as the product of their weights. A pair that violates both ways round is counted once, from
    its smaller side. Where one or two comparisons of order are all that joins the tuples, classes aren't joined either:
    their pairs are counted as inversions (`plans/dominance.py`). Counts beyond 2^63-1 fail, unless `exact` asks for
    decimals.
    """
    rule = F.lit(str(dc)).alias("rule")
    total = df.agg(F.count("*").alias("n"))
    if not dc.pairwise:
        d = rows(df, dc, numeric).agg(F.count("*").alias("dirty"))
        return d.join(F.broadcast(total)).select("dirty", F.col("n").alias("total"), F.col("dirty").alias("ordered_pairs"), rule)
    cols, preds = _columns(dc), _own(dc.preds, both_sides)
    scratch = scratch or Scratch(df.sparkSession)
    classes = scratch.write(df.groupBy(*cols).agg(F.count("*").alias("__w")), "classes").withColumn("__k", F.struct(*cols))
    a, b = sides(classes, [*cols, "__w", "__k"])
    if order := _only_order(preds):
        met, same = _ordered(classes, preds, order, numeric, self_pairs, scratch)
    else:
        met = _meet(a, b, preds, F.col("A___k") != F.col("B___k"), "A___k", "B___k", grid, numeric, scratch)
        product = wide(F.col("A___w")) * wide(F.col("B___w"))
        back = F.coalesce(_all(preds, SWAPPED, numeric), F.lit(False))
        met = met.select(product.alias("o"), F.when((F.col("A___k") < F.col("B___k")) | ~back, product).alias("u"))
        same = classes.filter(_all(preds, {"A": "", "B": ""}, numeric)).select((wide(F.col("__w")) * (wide(F.col("__w")) - (0 if self_pairs else 1))).alias("o"), pairs_of(F.col("__w")).alias("u"))
    j = met.select(F.col("o").cast("decimal(38,0)"), F.col("u").cast("decimal(38,0)")).unionByName(same.select(F.col("o").cast("decimal(38,0)"), F.col("u").cast("decimal(38,0)")))
    j = j.agg(F.coalesce(F.sum("u"), F.lit(0)).alias("u"), F.coalesce(F.sum("o"), F.lit(0)).alias("o")).join(F.broadcast(total))
    if clamp:
        return j.select(*clamped(F.col("o"), F.col("n"), exact), as_count(F.col("o"), exact).alias("ordered_pairs"), rule)
    return j.select(as_count(F.col("u"), exact).alias("dirty"), as_count(pairs_of(F.col("n")), exact).alias("total"), as_count(F.col("o"), exact).alias("ordered_pairs"), rule)
