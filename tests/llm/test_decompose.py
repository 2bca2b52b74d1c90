import random

import numpy as np
import pytest

from depguard.llm.decompose import clusters, decompose, decompose_array, record_groups
from depguard.plans import skew


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def graph(seed):
    rng = random.Random(seed)
    e = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)] + [(5, 5), (1, 0), (1, 0)]
    rng.shuffle(e)
    return e


@pytest.mark.parametrize("finish", [0, 50])
def test_components(spark, scratch, finish, monkeypatch):
    if finish:  # with hot vertices
        monkeypatch.setattr(skew, "hot_parts", lambda s: 5)
    e = graph(1)
    got = {r.v: r.c for r in decompose(spark.createDataFrame(e, "src bigint, dst bigint"), scratch, finish).collect()}
    assert got == union_find([x for x in e if x[0] != x[1]])


def test_clusters_are_connected(spark, scratch):
    e = [x for x in graph(2) if x[0] != x[1]]
    c = {r.v: r.c for r in clusters(spark.createDataFrame(e, "src bigint, dst bigint"), 0, scratch)[0].collect()}
    assert set(c) == {x for y in e for x in y}
    inside = union_find([(a, b) for a, b in e if c[a] == c[b]])
    assert all(inside.get(v, v) == inside.get(k, k) for v, k in c.items())
    assert len(set(c.values())) < 0.7 * len(c)


def test_long_chains_take_several_levels(spark, scratch, finish=20_000):
    n, seen = 100_000, []
    chain = spark.range(n).selectExpr("id * 7919 % 100003 AS src", "(id + 1) * 7919 % 100003 AS dst")
    out = decompose(chain, scratch, finish, seen)
    assert out.count() == n + 1 and out.select("c").distinct().collect() == [(0,)]
    assert len(seen) >= 3 and all(b < 0.7 * a for a, b in zip(seen, seen[1:]))


def test_in_one_task():
    rng = random.Random(6)
    for _ in range(40):
        e = [(rng.randint(-5, 60), rng.randint(-5, 60)) for _ in range(rng.randint(1, 50))] + [(i, i + 1) for i in range(100, 100 + rng.randint(1, 300))]
        e = [x for x in e if x[0] != x[1]]
        v, c, levels = decompose_array(*(np.array([x[i] for x in e]) for i in (0, 1)))
        least = {}
        for x, y in zip(v.tolist(), c.tolist()):
            least[y] = min(x, least.get(y, x))
        assert {x: least[y] for x, y in zip(v.tolist(), c.tolist())} == union_find(e)
    assert decompose_array(np.arange(10_000), np.arange(1, 10_001))[2] >= 5


@pytest.mark.parametrize("finish", [0, 20_000])
def test_records(spark, scratch, finish):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, f"z{rng.randint(0, 60)}"]), rng.choice([None, f"c{rng.randint(0, 200)}"]), "s") for i in range(1, 120)]
    rows += [(i, "hot", f"u{i}", None) for i in range(500, 700)] + [(800, None, None, "s"), (801, "", "q", "s"), (802, "", None, "s"), (803, "alone", None, "s")]
    edges = []
    for col in (1, 2):
        first = {}
        for r in rows:
            if r[col] is not None:
                edges.append((r[0], first.setdefault(r[col], r[0])))
    comp = union_find(edges)
    size = {}
    for r in rows:
        size[comp.get(r[0])] = size.get(comp.get(r[0]), 0) + 1
    want = {r[0]: comp[r[0]] for r in rows if r[0] in comp and size[comp[r[0]]] > 1}
    df = spark.createDataFrame(rows, "rec_id bigint, zip string, city string, group_id string")
    got = record_groups(df, "rec_id", ["zip", "city"], scratch, finish).collect()
    assert {r.rec_id: r.group_id for r in got} == want and len(got) == len(want)
    assert record_groups(df.limit(0), "rec_id", ["zip", "city"], scratch).count() == 0
