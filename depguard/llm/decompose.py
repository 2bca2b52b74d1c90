"""Pairwise matches consolidated into groups by low-diameter decomposition."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from depguard.plans.skew import hot_keys, spread_join
from depguard.session import Scratch

#: Rate of the exponential shifts and the largest shift (also the largest radius of a cluster and the rounds a level takes).
RATE, REACH = 0.6, 4
#: Levels of at most so many edges are decomposed within one task: a bounded piece of work.
FINISH_EDGES = 200_000


def _start(v: Column, level: int) -> Column:
    """When a vertex starts a cluster of its own: REACH - min(REACH, Exp(RATE)), from a hash of it and the level, so a lost
    task draws the same again. The many that start at 0 differ by a millionth at most."""
    u, w = ((F.pmod(F.xxhash64(F.lit(level), F.lit(i), v), F.lit(1 << 50)) + 0.5) / float(1 << 50) for i in (0, 1))
    return REACH - F.least(F.lit(float(REACH)), -F.log(u) / RATE) + w * 1e-6


def clusters(edges: DataFrame, level: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """v, c: one decomposition of the graph (src, dst, no loops), and the hot vertices (see plans.skew).

    A vertex goes to the cluster that reaches it first, its own included; each round every cluster takes the neighbours
    of the vertices it got in the round before. The state of a vertex is two numbers, so rounds aggregate by hash.
    """
    both = edges.union(edges.select("dst", "src")).toDF("v", "w")
    now = both.groupBy("v").agg(F.count("*").alias("n")).select("v", _start(F.col("v"), level).alias("t"), F.col("v").alias("c"), F.lit(True).alias("new"), "n")
    now = scratch.write(now, "state")
    hot = hot_keys(now, ["v"], "n", 2 * edges.count())
    for _ in range(REACH):
        told = now.filter("new").select("v", "t", "c")
        sent = spread_join(both, told, ["v"], hot) if hot is not None else both.join(told, "v")
        sent = sent.filter(F.col("t").isNotNull()).select(F.col("w").alias("v"), (F.col("t") + 1).alias("t"), "c", F.lit(None).cast("double").alias("old"))
        own = now.select("v", "t", "c", F.col("t").alias("old"))
        following = own.unionByName(sent).groupBy("v").agg(F.min("t").alias("t"), F.min_by("c", "t").alias("c"), F.max("old").alias("old"))
        following = following.select("v", "t", "c", (F.col("t") < F.col("old")).alias("new"))
        following = scratch.write(following, "state")
        scratch.drop(now)
        now = following
    return now.select("v", "c"), hot


def _shifts(v: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1) * np.uint64(0xD1B54A32D192ED03)
        for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(k))) * np.uint64(m)
        x ^= x >> np.uint64(31)
    return -np.log((x >> np.uint64(11)).astype(np.float64) / float(1 << 53) + 2**-54) / RATE


def decompose_array(src: np.ndarray, dst: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The same decomposition in memory, to the end: the vertices, a vertex that names the component of each, and the
    number of levels."""
    vertices, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    at, a, b, levels = np.arange(len(vertices)), ends[: len(src)], ends[len(src) :], 0
    while len(a):
        left, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, n = ends[: len(a)], ends[len(a) :], len(left)
        t, c = REACH - np.minimum(REACH, _shifts(vertices[left], level + levels)), np.arange(n)
        told, by = np.concatenate([x, y]), np.concatenate([y, x])
        for _ in range(REACH):
            order = np.lexsort((t[by], told))
            first = np.flatnonzero(np.diff(told[order], prepend=-1))
            to, of = told[order][first], by[order][first]
            better = t[of] + 1 < t[to]
            to, of = to[better], of[better]
            if not len(to):
                break
            t[to], c[to] = t[of] + 1, c[of]
        # Contraction: a vertex becomes its cluster's centre, in the edges and in what was found before.
        centre = np.arange(len(vertices))
        centre[left] = left[c]
        at, a, b = centre[at], centre[a], centre[b]
        keep = a != b
        pairs = np.unique(np.stack([np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])], axis=1), axis=0)
        a, b, levels = pairs[:, 0], pairs[:, 1], levels + 1
    return vertices, vertices[at], levels


def _finish(edges: DataFrame, level: int) -> DataFrame:
    """v, c of the components of at most FINISH_EDGES edges, decomposed in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            v, c, _ = decompose_array(*(np.concatenate([b[s].to_numpy() for b in got]) for s in ("src", "dst")), level)
            yield pd.DataFrame({"v": v, "c": c})

    return edges.coalesce(1).mapInPandas(run, "v bigint, c bigint")


def decompose(edges: DataFrame, scratch: Scratch, finish_edges: int = FINISH_EDGES, seen: list | None = None) -> DataFrame:
    """v, c for every vertex of the edges (src, dst bigint): c is the smallest vertex of its component.

    Level by level: clusters, contraction of each to its centre, and the same again for the edges between clusters,
    until none is left. From the second level on, what has at most `finish_edges` edges is decomposed in one task, in the
    same way. The assignments of the levels are then composed. Loops and repeated edges don't matter. Vertices of a large
    degree don't load one task: their states (at most as many as `hot_parts`) are broadcast to their edges. `seen` gets
    the number of edges of each level.
    """
    edges = scratch.write(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    maps: list[DataFrame] = []
    while left := edges.count():
        if seen is not None:
            seen.append(left)
        if maps and left <= finish_edges:
            maps.append(scratch.write(_finish(edges, len(maps)), "finish"))
            break
        c, hot = clusters(edges, len(maps), scratch)
        maps.append(c)
        ends = edges
        for side in ("src", "dst"):
            own = None if hot is None else hot.withColumnRenamed("v", side)
            ends = spread_join(ends, c.select(F.col("v").alias(side), F.col("c").alias(f"_{side}")), [side], own)
        following = ends.filter("_src <> _dst").select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).distinct()
        following = scratch.write(following, "edges")
        scratch.drop(edges)
        edges = following
    if not maps:
        return edges.select(F.col("src").alias("v"), F.col("dst").alias("c"))
    now, n = maps[0], None
    for m in maps[1:]:
        n = n or now.count()
        hot = hot_keys(now.groupBy("c").agg(F.count("*").alias("n")), ["c"], "n", n)
        now = spread_join(now, m.select(F.col("v").alias("c"), F.col("c").alias("_to")), ["c"], hot).select("v", F.coalesce("_to", "c").alias("c"))
        now = scratch.write(now, "composed")
    least = scratch.write(now.groupBy("c").agg(F.min("v").alias("_least"), F.count("*").alias("n")), "least")
    hot = hot_keys(least, ["c"], "n", n or now.count())
    return spread_join(now, least.drop("n"), ["c"], hot).select("v", F.col("_least").alias("c"))


def record_groups(df: DataFrame, key: str, links: list[str], scratch: Scratch, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """key, group_id for every record that shares a non-null value of a link column with another one, directly or
    through others; group_id is the smallest key of the group.

    The records of a value are represented by their smallest key, so a value with a third of all records is one vertex;
    a record is an edge between the representatives of its values. Keys are unique integers; rows with a null key, and
    rows alone with their values, are left out. An empty table gives no rows.
    """
    rows = df.select(F.col(key).cast("bigint").alias("_key"), *links).filter(F.col("_key").isNotNull())
    total = rows.count()
    j, values = rows, []
    for i, f in enumerate(links):
        low = scratch.write(rows.filter(F.col(f).isNotNull()).groupBy(f).agg(F.min("_key").alias(f"_m{i}"), F.count("*").alias(f"_n{i}")), "values")
        values.append(low)
        j = spread_join(j, low, [f], hot_keys(low, [f], f"_n{i}", total))
    j = scratch.write(j.drop(*links), "records")
    for low in values:
        scratch.drop(low)
    ends = [F.col(f"_m{i}") for i in range(len(links))]
    linked = j.filter(reduce(lambda a, b: a | b, (F.coalesce(F.col(f"_n{i}"), F.lit(0)) > 1 for i in range(len(links)))))
    linked = linked.select("_key", F.coalesce(*ends).alias("v"), F.array_compact(F.array(*ends)).alias("_all"))
    edges = linked.filter(F.size("_all") > 1).select(F.col("v").alias("src"), F.explode("_all").alias("dst"))
    cc = scratch.write(decompose(edges, scratch, finish_edges), "components")
    hot = hot_keys(linked.groupBy("v").agg(F.count("*").alias("n")), ["v"], "n", total)
    out = spread_join(linked.select("_key", "v"), cc, ["v"], hot)
    return out.select(F.col("_key").alias(key), F.coalesce("c", "v").alias("group_id"))
