"""Counts of pairs that two comparisons of order ask for, without the pairs.

`a.x > b.x and a.y < b.y` are inversions: with ties broken so that both orders are total, a comes after b in the one and
before b in the other. The points are cut into stripes of each order. A pair lies in one stripe of x, or in two of x and one
of y, or in two of both; the first two are counted within a stripe, by halving it again and again, the last from the
weights of the cells of both stripes. Each order costs one range shuffle, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from depguard.report import wide
from depguard.session import Scratch

#: Points of a stripe, about, and the most stripes of an order; with more points than both allow, stripes are longer.
STRIPE_ROWS, STRIPES = 100_000, 1_000


def inversions(keys: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> int:
    """The sum of wa[p]*wb[q] over p < q with keys[p] > keys[q]."""
    m = len(keys)
    v, p = np.empty(m, np.int64), np.arange(m)
    v[np.argsort(keys, kind="stable")] = p
    small = int(wa.sum()) * int(wb.sum()) < 2**62
    total = 0
    for k in reversed(range((m - 1).bit_length() if m else 0)):
        # Blocks of 2^(k+1) neighbouring ranks, each in the order of positions: its upper half against its lower one.
        up = (v >> k & 1).astype(bool)
        start = p >> (k + 1) << (k + 1)
        sums = np.concatenate([[0], np.cumsum(np.where(up, 0, wb))])
        ones = np.flatnonzero(up)
        after = sums[np.minimum(start[ones] + (2 << k), m)] - sums[ones]
        total += int(np.dot(wa[ones], after)) if small else sum(x * y for x, y in zip(wa[ones].tolist(), after.tolist()))
        lower = np.concatenate([[0], np.cumsum(~up)])
        before = lower[p] - lower[start]
        to = np.where(up, start + (1 << k) + (p - start - before), start + before)
        moved = [np.empty_like(x) for x in (v, wa, wb)]
        for x, y in zip(moved, (v, wa, wb)):
            x[to] = y
        v, wa, wb = moved
    return total


def _numpy(batches: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    table = pa.Table.from_batches(batches)
    return [table[c].to_numpy() for c in names]


def _decimal(values: list) -> pa.Array:
    return pa.array([None if x is None else Decimal(x) for x in values], pa.decimal128(38, 0))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a stripe of x, in order of y; the first one gets its count."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    n = inversions(*_numpy(rows, "__i", "__wa", "__wb"))
    for at, b in enumerate(rows):
        yield pa.RecordBatch.from_arrays([*b.columns, _decimal([n if at == 0 else None, *[None] * (b.num_rows - 1)])], names=[*b.schema.names, "__c"])


def _across(stripes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stripe of y, in its order: the count of pairs of different stripes of x, and the weights in each of these."""
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        s, r, wa, wb = _numpy(rows, "s", "r", "__wa", "__wb")
        a, b = np.zeros(stripes, np.int64), np.zeros(stripes, np.int64)
        np.add.at(a, r, wa)
        np.add.at(b, r, wb)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([int(s[0])], pa.int32()), _decimal([inversions(r, wa, wb)]), pa.array([a], kind), pa.array([b], kind)], names=["s", "c", "a", "b"])

    return run


def count_ordered(points: DataFrame, op_x: str, op_y: str, scratch: Scratch, stripes: int | None = None) -> DataFrame:
    """n, of one or several rows whose sum is that of a.__wa * b.__wb over pairs of different points a, b with
    `a.__x op_x b.__x` and `a.__y op_y b.__y`; ops are < <= > >=.

    points: one row for each __x, __y, neither null, with bigint weights __wa and __wb; a written table, as it is read more than once.
    """
    if stripes is None:
        stripes = min(STRIPES, max(points.sparkSession.sparkContext.defaultParallelism, -(-points.count() // STRIPE_ROWS)))
    # a after b in the order of x, and before b in that of y.
    x_up, y_up = op_x[0] == ">", op_y[0] == "<"
    by = lambda c, up: F.col(c).asc() if up else F.col(c).desc()
    # Of points equal in x the one that is first by y is first, so it is no pair; if equal values are to count, it is last.
    along_x: list[Column] = [by("__x", x_up), by("__y", y_up == ("=" not in op_x))]
    along_y: list[Column] = [by("__y", y_up), by("__x", x_up == ("=" not in op_y))]
    points = points.select("__x", "__y", "__wa", "__wb")
    ranked = points.repartitionByRange(stripes, *along_x).sortWithinPartitions(*along_x).withColumn("__i", F.monotonically_increasing_id())
    kinds = T.StructType([*ranked.schema.fields, T.StructField("__c", T.DecimalType(38, 0))])
    kept = scratch.write(ranked.sortWithinPartitions(*along_y).mapInArrow(_within, kinds), "stripes")
    near = scratch.write(kept.agg(F.sum("__c").alias("n")), "near")
    placed = kept.repartitionByRange(stripes, *along_y).sortWithinPartitions(*along_y)
    # A task's number is in the upper bits of the ids it gives.
    placed = placed.select(F.spark_partition_id().alias("s"), F.shiftright("__i", 33).cast("int").alias("r"), "__wa", "__wb")
    cells = scratch.write(placed.mapInArrow(_across(stripes), "s int, c decimal(38,0), a array<bigint>, b array<bigint>"), "cells")
    scratch.drop(kept)
    each = cells.select("s", F.posexplode(F.arrays_zip("a", "b")).alias("r", "w")).select("s", "r", "w.a", "w.b")
    later = Window.partitionBy("r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    far = each.withColumn("b", F.sum("b").over(later)).withColumn("b", F.sum("b").over(lower)).agg(F.sum(wide(F.col("a")) * wide(F.col("b"))).cast("decimal(38,0)").alias("n"))
    return near.unionByName(cells.select(F.col("c").alias("n"))).unionByName(far)
