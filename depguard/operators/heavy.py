"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depguard.plans.skew import place
from depguard.session import Scratch

#: Keys that one task holds in its hash table, about.
HASH_KEYS = 500_000


def per_key_report(df: DataFrame, key: str, dependent: str, scratch: Scratch, slots: int | None = None) -> DataFrame:
    """key_value, n, dirty, vote, shards, total of each non-null key: rows, rows whose dependent differs from the vote,
    the most frequent non-null dependent (the smallest on a tie), tasks the key was spread over, rows of the table.

    Fragment and replicate by load. The load of each key comes from counts combined before their shuffle. Keys are then
    bin-packed to `slots` tasks, a key above a task's share is cut into equal shards, rows of such a key go round its
    shards, and its vote is copied to those shards only. Each task joins and counts what it has; the few partial
    counts a key has are summed at the end. So no task gets much more than rows/slots, however the keys are spread.

    Empty table: no rows. A key whose dependents are all null has a null vote and no dirty row. Repeated rows count.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_k"), F.col(dependent).alias("_d"))
    counts = scratch.write(rows.groupBy("_k", "_d").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    best = F.min(F.when(F.col("_d").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("_d").alias("d"))))
    loads = scratch.write(counts.dropna(subset=["_k"]).groupBy("_k").agg(F.sum("n").alias("load"), best["d"].alias("_vote")), "loads")
    scratch.drop(counts)
    # A task builds a hash table of its keys: their number bounds it.
    slots = slots or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-loads.count() // HASH_KEYS))
    where = place(loads, "_k", "load", slots)
    left = where.mark(rows.filter(F.col("_k").isNotNull()).withColumn("_i", F.monotonically_increasing_id()))
    left = left.select("_k", "_d", where.slot(F.col("_i")).alias("_slot")).repartitionById(slots, "_slot")
    right = where.mark(loads).select("_k", "_vote", F.explode(where.shards()).alias("_slot")).repartitionById(slots, "_slot")
    part = (
        left.join(right.hint("shuffle_hash"), ["_slot", "_k"]).groupBy("_slot", "_k", "_vote")
        .agg(F.count("*").alias("n"), F.count_if(~F.col("_d").eqNullSafe(F.col("_vote"))).alias("dirty"))
    )
    return part.groupBy("_k", "_vote").agg(F.sum("n").alias("n"), F.sum("dirty").alias("dirty"), F.count("*").alias("shards")).select(
        F.col("_k").alias("key_value"), "n", F.when(F.col("_vote").isNull(), 0).otherwise(F.col("dirty")).alias("dirty"),
        F.col("_vote").alias("vote"), "shards", F.lit(total).cast("bigint").alias("total"),
    )
