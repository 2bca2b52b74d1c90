"""Repair of functional dependencies by vote; equivalence classes for right sides that several rules share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from depguard.operators.components import connected_components
from depguard.operators.fd import _present, value_counts
from depguard.plans.schedule import schedule
from depguard.plans.skew import hot_keys, spread_join
from depguard.report import report
from depguard.rules import FD, FDSet
from depguard.session import Scratch

VISITED, CHANGED, CLASS = "_visited", "_changed", "_class"


@dataclass
class RepairResult:
    """df: the repaired table with its own columns (and the flags if asked for); flagged: always with the flags."""

    df: DataFrame
    flagged: DataFrame
    rule: str
    unrepaired: list[str] = field(default_factory=list)

    def report(self, by: str = VISITED) -> DataFrame:
        """dirty = rows of repaired groups (VISITED) or rows with another value now (CHANGED)."""
        return report(self.flagged, F.sum(F.when(F.col(by), 1)), F.count("*"), self.rule)


def vote(df: DataFrame, lhs: tuple[str, ...], rhs: str, kind: str = "plurality", unanimous: bool = False) -> DataFrame:
    """lhs.., winner: the value each violating group is repaired to.

    plurality: the most frequent non-null value, the smallest on a tie. majority: a value that more than half of the
    rows have (null rows count in the total, null never wins). Groups with one value have no row, unless `unanimous`
    asks for these entries that change nothing.
    """
    return _winners(_tally(df, lhs, rhs), lhs, kind, unanimous).withColumnRenamed("__win", "winner")


def _tally(df: DataFrame, lhs: tuple[str, ...], rhs: str) -> DataFrame:
    """lhs.., __v values, __t rows, __best (rows, value) of every left value."""
    best = F.min(F.when(F.col(rhs).isNotNull(), F.struct((-F.col("__n")).alias("n"), F.col(rhs).alias("r"))))
    return value_counts(df.filter(_present(lhs)), lhs, rhs).groupBy(*lhs).agg(F.count("*").alias("__v"), F.sum("__n").alias("__t"), best.alias("__best"))


def _winners(top: DataFrame, lhs: tuple[str, ...], kind: str, unanimous: bool = False) -> DataFrame:
    top = top.filter(((F.col("__v") > 1) | F.lit(unanimous)) & F.col("__best").isNotNull())
    if kind == "majority":
        top = top.filter(F.col("__best.n") * -2 > F.col("__t"))
    elif kind != "plurality":
        raise ValueError(f"vote is plurality or majority, not {kind!r}")
    return top.select(*lhs, F.col("__best.r").alias("__win"))


def _voted(df: DataFrame, lhs: tuple[str, ...], rhs: str, kind: str, scratch: Scratch) -> DataFrame:
    """The table with the winners of its groups written; a left value that holds a large part of the rows doesn't load one
    task (see plans.skew)."""
    top = scratch.write(_tally(df, lhs, rhs), "tally")
    hot = hot_keys(top, list(lhs), "__t", top.agg(F.sum("__t")).first()[0] or 0)
    return apply_fix(df, _winners(top, lhs, kind), lhs, rhs, hot)


def _with_flags(df: DataFrame) -> DataFrame:
    return df if VISITED in df.columns else df.withColumns({VISITED: F.lit(False), CHANGED: F.lit(False)})


def apply_fix(df: DataFrame, fix: DataFrame, lhs: tuple[str, ...], rhs: str, hot: DataFrame | None = None) -> DataFrame:
    """Write the winners (lhs.., __win); every row of a repaired group is visited, those with another value are changed."""
    cols = _with_flags(df).columns
    j = spread_join(_with_flags(df), fix, list(lhs), hot)
    hit = F.col("__win").isNotNull()
    return j.withColumns(
        {
            VISITED: F.col(VISITED) | hit,
            CHANGED: F.col(CHANGED) | (hit & ~F.col("__win").eqNullSafe(F.col(rhs))),
            rhs: F.coalesce("__win", rhs),
        }
    ).select(*cols)


def _short(c: str) -> Column:
    """A column as a key: null stays null, long strings become their SHA-256, so keys have a bounded width."""
    text = F.col(c).cast("string")
    return F.when(F.length(text) > 40, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def equivalence_classes(df: DataFrame, lefts: list[tuple[str, ...]], scratch: Scratch, label: str = CLASS) -> DataFrame:
    """The table with a column `label`: rows equal on all columns of some left side are in one class, through any chain.

    The label is the smallest number of a row of the class (numbers are given here). Nulls connect nothing; a row whose
    left sides all have a null gets null. Long strings meet by their SHA-256. Left values and classes that hold a large
    part of the rows don't load one task.
    """
    numbered = scratch.write(df.withColumn("__no", F.monotonically_increasing_id()), "rows")
    total, ends = numbered.count(), []
    used = list(dict.fromkeys(c for lhs in lefts for c in lhs))
    j = numbered.select("__no", *(_short(c).alias(f"__k{i}") for i, c in enumerate(used)))
    for i, lhs in enumerate(lefts):
        keys = [f"__k{used.index(c)}" for c in lhs]
        low = scratch.write(j.filter(_present(tuple(keys))).groupBy(*keys).agg(F.min("__no").alias(f"__m{i}"), F.count("*").alias("__n")), "left")
        j = spread_join(j, low.drop("__n"), keys, hot_keys(low, keys, "__n", total))
        ends.append(f"__m{i}")
    j = scratch.write(j.select("__no", *ends), "ends")
    first = F.coalesce(*(F.col(e) for e in ends))
    edges = j.select(first.alias("src"), F.explode(F.array(*(F.col(e) for e in ends))).alias("dst")).dropna()
    cc = connected_components(edges.distinct(), scratch).toDF("__node", label)
    j = j.select("__no", first.alias("__node"))
    hot = hot_keys(j.groupBy("__node").agg(F.count("*").alias("n")), ["__node"], "n", total)
    named = spread_join(j, cc, ["__node"], hot).drop("__node")
    return numbered.join(named, "__no").select(*df.columns, label)


def value_classes(df: DataFrame, x1: str, x2: str, scratch: Scratch, label: str = "eqclass") -> DataFrame:
    """The table with `label`: the smallest x1 value among all that share x2 values with it, through any chain.

    Rows with a null x1 take the class of their x2 value if that has one, else null. Only the different pairs are classed;
    rows get the label back by their pair.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), _short(c)), F.lit(""))  # noqa: E731 - null apart from empty
    pairs = scratch.write(df.groupBy(x1, x2).agg(F.count("*").alias("__n")), "pairs")
    c = scratch.write(equivalence_classes(pairs, [(x1,), (x2,)], scratch), "values")
    sizes = scratch.write(c.groupBy(CLASS).agg(F.min(x1).alias(label), F.count("*").alias("__n")), "names")
    named = spread_join(c.select(x1, x2, CLASS, F.col("__n").alias("__rows")), sizes.drop("__n"), [CLASS], hot_keys(sizes, [CLASS], "__n", c.count()))
    named = scratch.write(named.select(key(x1).alias("__a"), key(x2).alias("__b"), "__rows", label), "named")
    hot = hot_keys(named, ["__a", "__b"], "__rows", named.agg(F.sum("__rows")).first()[0] or 0)
    out = spread_join(df.drop(label).withColumns({"__a": key(x1), "__b": key(x2)}), named.drop("__rows"), ["__a", "__b"], hot)
    return out.select(*(c for c in df.columns if c != label), label)


def repair_shared(df: DataFrame, rules: list[FD], scratch: Scratch, kind: str = "plurality") -> DataFrame:
    """One right side with several left sides: vote per equivalence class of rows."""
    classed = scratch.write(equivalence_classes(_with_flags(df), [r.lhs for r in rules], scratch), "classed")
    return _voted(classed, (CLASS,), rules[0].rhs, kind, scratch).drop(CLASS)


def repair(df: DataFrame, rules: FD | FDSet, scratch: Scratch | None = None, kind: str = "plurality", shared: bool = True, flags: bool = False) -> RepairResult:
    """Repair a rule or a set of rules, each right side after all it depends on.

    Rules on a cycle, or behind one, are left alone and named in `unrepaired`. Several rules for one right side are
    repaired on equivalence classes (shared) or one after the other. After each right side the table is written to the
    shared folder when more follow, so plans stay short.
    """
    listed = list(rules.rules) if isinstance(rules, FDSet) else [rules]
    order, left = schedule(listed)
    scratch = scratch or Scratch(df.sparkSession)
    out = _with_flags(df)
    for i, (rhs, own) in enumerate(order):
        if len(own) > 1 and shared:
            out = repair_shared(out, own, scratch, kind)
        else:
            for r in own:
                out = _voted(out, r.lhs, r.rhs, kind, scratch)
        if i + 1 < len(order):
            out = scratch.write(out, f"repair{i}")
    cols = [*df.columns, *([VISITED, CHANGED] if flags else [])]
    return RepairResult(out.select(*dict.fromkeys(cols)), out, str(rules), left)


def class_audit(df: DataFrame, y: str, label: str = "eqclass") -> DataFrame:
    """Classes with two or more values of y (null counts as one), with the number of values and of rows."""
    return (
        df.filter(F.col(label).isNotNull()).groupBy(label, y).agg(F.count("*").alias("n")).groupBy(label)
        .agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows")).filter("n_values > 1")
    )
