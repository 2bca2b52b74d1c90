"""Pointwise order dependencies, checked for an added batch against a base."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from depguard.plans.pairs import COMPARE
from depguard.plans.skew import fragment_join, hot_cuts
from depguard.rules import POD
from depguard.rules.model import MIRROR, NEGATE
from depguard.session import Scratch


def compress(base: DataFrame, cols: list[str], key: str) -> DataFrame:
    """rep, cols.., n: rows equal on all cols are one, its smallest key the representative. One hash aggregate."""
    return base.groupBy(*cols).agg(F.min(key).alias("rep"), F.count("*").alias("n"))


def representatives(base: DataFrame, cols: list[str], key: str) -> DataFrame:
    """key, rep for every row."""
    on = F.lit(True)
    c = compress(base, cols, key).select("rep", *(F.col(x).alias(f"_{x}") for x in cols))
    for x in cols:
        on = on & F.col(x).eqNullSafe(F.col(f"_{x}"))
    return base.join(c, on).select(key, "rep")


def _violates(rule: POD, t: str, s: str, mirror: bool) -> Column:
    """Tuple t stands to s as the left side says (or the other way round), and the right side fails."""
    out = F.lit(True)
    for c, op in rule.lhs:
        out = out & COMPARE[MIRROR[op] if mirror else op](F.col(f"{t}{c}"), F.col(f"{s}{c}"))
    c, op = rule.rhs
    op = NEGATE[MIRROR[op] if mirror else op]
    return out & COMPARE[op](F.col(f"{t}{c}"), F.col(f"{s}{c}"))


def _zones_meet(rule: POD, mirror: bool) -> Column:
    """Two zones can hold a violating pair only if their ranges allow each comparison: a test on their bounds."""
    terms = [(c, MIRROR[op] if mirror else op) for c, op in rule.lhs]
    c, op = rule.rhs
    terms.append((c, NEGATE[MIRROR[op] if mirror else op]))
    out = F.lit(True)
    for c, op in terms:
        lo_t, hi_t, lo_s, hi_s = (F.col(f"{x}{c}") for x in ("lo_t_", "hi_t_", "lo_s_", "hi_s_"))
        tests = {
            ">": hi_t > lo_s, ">=": hi_t >= lo_s, "<": lo_t < hi_s, "<=": lo_t <= hi_s,
            "=": (lo_t <= hi_s) & (lo_s <= hi_t), "!=": ~((lo_t == hi_t) & (lo_s == hi_s) & (lo_t == lo_s)),
        }
        out = out & tests[op]
    return out


#: Rows of the base in a cell, about, and the bounds of the number of stripes each way.
CELL_ROWS, STRIPES = 2_000, (16, 256)


def pod_incremental(base: DataFrame, add: DataFrame, rule: POD, key: str, stripes: int | None = None, within_add: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """add_id, base_id, direction: the pairs (t of add, s of base) that violate the rule in one of its orientations.

    direction is 1 if t stands to s as the left side says, -1 if the other way round, 0 if both hold. Rows with a null
    in any column of the rule violate nothing. Both tables are cut into stripes*stripes cells by quantiles of the base's
    first left and right columns, as many as its rows need. Each cell's ranges in all columns are known (two small tables
    of at most stripes*stripes rows); cells that can't hold a violating pair are told apart by them, and rows of the batch
    are sent only to cells that can. Cells that make a large part of the comparisons are cut into pieces by load.
    """
    scratch = scratch or Scratch(base.sparkSession)
    cols = list(dict.fromkeys([*(c for c, _ in rule.lhs), rule.rhs[0]]))
    one = lambda df, p: df.select(F.col(key).alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in cols)).dropna()
    t = one(add, "t_")
    base_rows = one(base, "s_")
    if within_add:
        base_rows = base_rows.unionByName(one(add, "s_"))
    first, last = cols[0], rule.rhs[0]
    stripes = stripes or min(STRIPES[1], max(STRIPES[0], math.ceil(math.sqrt(base_rows.count() / CELL_ROWS))))
    cuts = [i / stripes for i in range(1, stripes)]
    qx, qy = base_rows.select(F.col(f"s_{first}").cast("double").alias("x"), F.col(f"s_{last}").cast("double").alias("y")).approxQuantile(["x", "y"], cuts, 0.001) or ([], [])

    def celled(df: DataFrame, p: str) -> DataFrame:
        stripe = lambda c, q: F.size(F.filter(F.array(*map(F.lit, sorted(set(q)))), lambda v: v < F.col(c).cast("double"))) if q else F.lit(0)
        return scratch.write(df.withColumn(f"{p}cell", stripe(f"{p}{first}", qx) * 1000 + stripe(f"{p}{last}", qy)), "cells")

    def zones(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(f"{p}cell").agg(F.count("*").alias(f"{p}n"), *(f(f"{p}{c}").alias(f"{n}_{p}{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))))

    t, s = celled(t, "t_"), celled(base_rows, "s_")
    can_meet = _zones_meet(rule, False) | _zones_meet(rule, True)
    meet = scratch.write(zones(t, "t_").join(F.broadcast(zones(s, "s_")), can_meet), "meet")
    loads = meet.groupBy("s_cell").agg(F.sum(F.col("t_n").cast("double") * F.col("s_n")).alias("load"))
    cut = hot_cuts(loads, ["s_cell"], "load", loads.agg(F.sum("load")).first()[0] or 0)
    # A row itself must be able to meet the cell, not only its own cell's ranges.
    sent = t.join(meet.select("t_cell", "s_cell", *(f"{n}_s_{c}" for c in cols for n in ("lo", "hi"))), "t_cell")
    own = [F.col(f"t_{c}").alias(f"{n}_t_{c}") for c in cols for n in ("lo", "hi")]
    sent = sent.select("*", *own).filter(can_meet).select("t_id", *(f"t_{c}" for c in cols), "s_cell")
    up, down = _violates(rule, "t_", "s_", False), _violates(rule, "t_", "s_", True)
    on = (up | down) & (F.col("t_id") != F.col("s_id") if within_add else F.lit(True))
    j = fragment_join(sent, s, ["s_cell"], cut, F.xxhash64("t_id"), on)
    return j.select(F.col("t_id").alias("add_id"), F.col("s_id").alias("base_id"), F.when(up & down, 0).when(up, 1).otherwise(-1).alias("direction"))
