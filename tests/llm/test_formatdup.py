import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from depguard.llm import formatdup
from depguard.llm.formatdup import CopyRule, collapse, copies
from depguard.llm.queries import ADDR

SCHEMA = "id int, zip string, city string, state string, phone string, salary int, areacode int, fname string, leve int, copies string"


def norm(v):
    return None if v is None else "".join(c for c in v if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd").lower()


def brute(rows):
    groups = {}
    for r in rows:
        f, c = norm(r[7]), norm(r[2])
        pair = (f, c) if f is None or c is None else tuple(sorted((f, c)))
        groups.setdefault((r[1], r[3], r[4], r[5], r[6], r[8], pair, f is None, c is None), []).append(r[0])
    return {i: (min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g}


def rows_for(n, seed):
    rng = random.Random(seed)
    names = ["Ann Lee", "ann-lee", "ANNLEE", "Änn Lee", None, "", "--", "Rome", "ROME.", " rome", "Ro\u200bme", "«Rome»", "x" * 20000, "X" * 20000, "ÉVE", "éve", "eve", "e\u0301ve"]
    return [(i, rng.choice(["1", "2", None]), rng.choice(names), rng.choice(["A", None]), "p", rng.choice([1, None]), None, rng.choice(names), 1, "kept") for i in range(n)]


@pytest.mark.parametrize("parts", [200, 3])
def test_against_brute_force(spark, scratch, parts, monkeypatch):
    monkeypatch.setattr(formatdup, "hot_keys", lambda *a: __import__("depguard.plans.skew", fromlist=["x"]).hot_keys(*a, parts=parts))
    rows = rows_for(700, 2) + [(10_000 + i, "9", "Hot City", "S", "p", 1, 1, "HOTNAME", 1, None) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.id: (r.rep_id, r.copies) for r in copies(df, "id", ADDR, scratch).collect()}
    assert got == brute(rows)


def test_colliding_fingerprints_part(spark, scratch, monkeypatch):
    monkeypatch.setattr(formatdup, "fingerprint", lambda rule: [F.lit(1).cast("bigint").alias("_a"), F.lit(2).cast("bigint").alias("_b")])
    rows = rows_for(300, 4)
    got = {r.id: (r.rep_id, r.copies) for r in copies(spark.createDataFrame(rows, SCHEMA), "id", ADDR, scratch).collect()}
    assert got == brute(rows)


def test_collapse_and_empty(spark, scratch):
    rows = rows_for(200, 6)
    out = collapse(spark.createDataFrame(rows, SCHEMA), "id", ADDR, scratch)
    sets = brute(rows)
    assert {r.id: r._copies for r in out.collect()} == {r[0]: sets.get(r[0], (0, 1))[1] for r in rows if sets.get(r[0], (r[0],))[0] == r[0]}
    assert "copies" in out.columns
    assert copies(spark.createDataFrame([], SCHEMA), "id", ADDR, scratch).count() == 0


def test_three_swappable_fields(spark, scratch):
    df = spark.createDataFrame([(1, "a", "B", "c"), (2, "C", "a", "b"), (3, "a", "b", None), (4, "b", "a", None), (5, "a", "a", "b"), (6, "b", "b", "a")], "id int, x string, y string, z string")
    got = [(r.rep_id, r.id) for r in copies(df, "id", CopyRule((), ("x", "y", "z"), ("x", "y", "z")), scratch).collect()]
    assert sorted(got) == [(1, 1), (1, 2)]
