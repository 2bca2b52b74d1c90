"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from depguard.plans.skew import hot_keys, spread_join
from depguard.session import Scratch


#: Graphs of at most so many edges are done by one task: a bounded piece of work.
ONE_TASK_EDGES = 200_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node, component of a graph (u, v) of at most ONE_TASK_EDGES edges: labels hook to smaller ones and are shortened."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        u, v = (np.concatenate([b[c].to_numpy() for b in got]) for c in "uv")
        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        label, a, b = np.arange(len(nodes)), ends[: len(u)], ends[len(u) :]
        while len(a):
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        yield pd.DataFrame({"node": nodes, "component": nodes[label]})

    return edges.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 64, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """node, component (the smallest node of it) for the edges (src, dst) of one orderable type.

    Alternates large-star and small-star steps; each halves what is left of long chains and shortens hubs to stars. A
    round is written to the shared folder; the loop ends when two sums over the edges no longer change. Graphs of at most
    `one_task` edges are done by one task, with the same result. Self loops are allowed and keep lone nodes.
    """
    loops = edges.filter("src = dst").select(F.col("src").alias("node"))
    now = scratch.write(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    if now.count() <= one_task:
        linked = scratch.write(_in_one_task(now), "cc")
        return linked.union(loops.distinct().join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))
    seen = None

    def lowest(pairs: DataFrame, low) -> tuple[DataFrame, DataFrame]:
        """The lowest neighbour of each node, and the pairs with it; hubs don't load one task."""
        least = scratch.write(pairs.groupBy("u").agg(low.alias("m"), F.count("*").alias("n")), "low")
        hot = hot_keys(least, ["u"], "n", least.agg(F.sum("n")).first()[0] or 0)
        least = least.drop("n")
        return least, spread_join(pairs, least, ["u"], hot)

    for _ in range(rounds):
        _, met = lowest(now.union(now.select("v", "u")), F.least(F.min("v"), F.col("u")))
        large = scratch.write(met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low, met = lowest(large, F.min("v"))
        small = met.filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        following = scratch.write(small.union(low).distinct(), "cc")
        scratch.drop(large)
        mark = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = following
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).union(loops).distinct()
    return linked.union(roots.join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))
