"""Joins and placement for keys that hold a large part of all rows.

Every function here treats the hot keys apart from the rest. A key is hot if it holds at least 1/`parts` of the rows, so
there are at most `parts` of them: that is the proven bound on all that is collected or broadcast in this module.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The least number of parts. With more shuffle partitions it is FAIR times their number, so that a key that isn't hot
#: adds at most 1/FAIR of an even share to the task it falls to.
HOT_PARTS, FAIR = 200, 4


def hot_parts(spark: SparkSession) -> int:
    return max(HOT_PARTS, FAIR * int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int, parts: int | None = None) -> DataFrame | None:
    """The at most `parts` key values of `counts` whose `n` is at least total/parts; None if there are none.

    `counts` has one row a key. Null keys are left out: they join nothing.
    """
    parts = parts or hot_parts(counts.sparkSession)
    rows = counts.filter(F.col(n) * parts >= F.lit(max(total, 1))).dropna(subset=keys).select(*keys).take(parts)
    return counts.sparkSession.createDataFrame(rows, counts.select(*keys).schema) if rows else None


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left JOIN right on `keys`, right having one row a key; how is inner, left or left_semi.

    Rows of hot keys never move: the few matching rows of `right` are broadcast to them. All others are joined by a
    shuffle as usual.
    """
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    apart = left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    return apart.unionByName(left.join(hot, keys, "left_anti").join(right.join(hot, keys, "left_anti"), keys, how))


def _spread(away: Column, cols: list[str]) -> Column:
    """0, or for rows that are to go anywhere a number from 1 on. It depends on the row and the partition that holds it, so
    a task that is run again sends each row where it went before, and equal rows of different partitions part."""
    return F.when(away, F.pmod(F.xxhash64(F.spark_partition_id(), *(F.col(c) for c in cols)), F.lit(1 << 20)) + 1).otherwise(F.lit(0)).cast("int")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """left LEFT JOIN right on `keys`, right having one row a key, with `left` read once.

    The few rows of `right` for hot keys are broadcast. The rows that have met them, and those with a null in a key, are
    spread evenly over the tasks of the join that the others go through.
    """
    values = [c for c in right.columns if c not in keys]
    away = F.lit(False)
    for k in keys:
        away = away | F.col(k).isNull()
    now = left
    if hot is not None:
        near = F.broadcast(F.broadcast(hot).join(right, keys, "left").select(*keys, F.struct(*values).alias("__near")))
        now, away = now.join(near, keys, "left"), away | F.col("__near").isNotNull()
    now = now.withColumn("__to", _spread(away, [c for c, kind in left.dtypes if "map<" not in kind and kind != "variant"]))
    far = right.select(*keys, *(F.col(c).alias(f"__far_{c}") for c in values), F.lit(0).alias("__to"))
    now = now.join(far, [*keys, "__to"], "left")
    pick = lambda c: F.col(f"__far_{c}") if hot is None else F.when(F.col("__near").isNotNull(), F.col("__near")[c]).otherwise(F.col(f"__far_{c}"))
    return now.select(*left.columns, *(pick(c).alias(c) for c in values))


def hot_cuts(counts: DataFrame, keys: list[str], n: str, total: int, parts: int | None = None) -> DataFrame | None:
    """As `hot_keys`, with the number of pieces (__cuts) that bring a piece of each key down to total/parts rows."""
    parts = parts or hot_parts(counts.sparkSession)
    rows = counts.filter(F.col(n) * parts >= F.lit(max(total, 1))).dropna(subset=keys).select(*keys, F.ceil(F.col(n) * parts / max(total, 1)).cast("int").alias("__cuts"))
    kept = rows.take(parts)
    return counts.sparkSession.createDataFrame(kept, rows.schema) if kept else None


def fragment_join(left: DataFrame, right: DataFrame, keys: list[str], cuts: DataFrame | None, by: Column, on: Column | None = None, how: str = "inner") -> DataFrame:
    """left JOIN right on `keys`, where both sides may have many rows a key, and `on` if given; how is inner or left_semi.
    `by` tells rows of `left` apart.

    Fragment and replicate: the rows of a hot key on the left are spread over its pieces, those on the right are copied to
    each of them. Columns of the two sides must differ but for the keys.
    """
    if cuts is not None:
        few = F.broadcast(cuts)
        left = left.join(few, keys, "left").withColumn("__piece", F.coalesce(F.pmod(by, F.col("__cuts")), F.lit(0)).cast("int")).drop("__cuts")
        right = right.join(few, keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__cuts", F.lit(1)) - 1))).drop("__cuts")
        keys = [*keys, "__piece"]
    right = right.withColumnsRenamed({k: f"__r{k}" for k in keys})
    met = on if on is not None else F.lit(True)
    for k in keys:
        met = met & (F.col(k) == F.col(f"__r{k}"))
    return left.join(right, met, how).drop("__piece", *(f"__r{k}" for k in keys))


@dataclass
class Placement:
    """Where each key goes. `table`: one row for each key placed by the packer: key, slots (array of its slots)."""

    table: DataFrame | None
    slots: int
    key: str

    def slot(self, shard: Column) -> Column:
        """The slot of a row: one of its key's slots, picked by `shard`; keys that weren't packed go by hash."""
        by_hash = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.slots)).cast("int")
        if self.table is None:
            return by_hash
        return F.coalesce(F.element_at(F.col("_slots"), (F.pmod(shard, F.size("_slots")) + 1).cast("int")), by_hash)

    def mark(self, df: DataFrame) -> DataFrame:
        return df if self.table is None else df.join(F.broadcast(self.table), self.key, "left")

    def shards(self) -> Column:
        """All slots of a key, for the side that is replicated."""
        by_hash = F.array(F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.slots)).cast("int"))
        return by_hash if self.table is None else F.coalesce(F.col("_slots"), by_hash)


def place(loads: DataFrame, key: str, n: str, slots: int, grain: int = 16) -> Placement:
    """Bin-pack keys to `slots` tasks by their load.

    Only keys of at least 1/(slots*grain) of the load are packed one by one (at most slots*grain rows reach the
    driver). What is below that size is spread evenly by hash, so it adds the same base load to every slot. A packed key
    larger than the room a slot has beside its base load is cut into as many equal shards as it needs; shards are put,
    longest first, each on the emptiest slot that has none of that key.
    """
    loads = loads.dropna(subset=[key])
    total = loads.agg(F.sum(n)).first()[0] or 0
    if not total:
        return Placement(None, slots, key)
    large = [(r[0], r[1]) for r in loads.filter(F.col(n) * slots * grain >= total).select(key, n).take(slots * grain)]
    if not large:
        return Placement(None, slots, key)
    rest = total - sum(x for _, x in large)
    free = [(rest / slots, i) for i in range(slots)]
    heapq.heapify(free)
    room = max(total / slots - rest / slots, total / slots / grain)
    pieces = []
    for k, load in large:
        cuts = min(slots, max(1, math.ceil(load / room)))
        pieces += [(load / cuts, k)] * cuts
    at: dict = {}
    for load, k in sorted(pieces, key=lambda p: (-p[0], str(p[1]))):
        skipped = []
        while True:
            used, slot = heapq.heappop(free)
            if slot not in at.setdefault(k, []):
                break
            skipped.append((used, slot))
        at[k].append(slot)
        for x in skipped:
            heapq.heappush(free, x)
        heapq.heappush(free, (used + load, slot))
    kind = dict(loads.dtypes)[key]
    return Placement(loads.sparkSession.createDataFrame(list(at.items()), f"`{key}` {kind}, _slots array<int>"), slots, key)
