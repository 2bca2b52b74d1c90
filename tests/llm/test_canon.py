import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depguard.llm.canon import BKForest, _codes, distance, distances, fold, map_to_list, radius

REF = [(1, "Saint Mídri", "AD", "Wotupeland"), (2, "Pojuskirt", "GP", "Veikust Coast"), (3, "Pojuskirt", "NB", "Greitrunia"), (4, "Cilix-Prin", "DG", "Komeim Hills"), (5, "Upper Taegrolk", "WP", "Thosen"), (6, "Tefer", "VK", "Geiskuvu Coast")]
words = st.text("abc", max_size=7)


def plain(a, b):
    """Damerau-Levenshtein by its textbook recurrence."""
    inf, da = len(a) + len(b), {}
    d = [[0] * (len(b) + 2) for _ in range(len(a) + 2)]
    d[0][0] = inf
    for i in range(len(a) + 1):
        d[i + 1][0], d[i + 1][1] = inf, i
    for j in range(len(b) + 1):
        d[0][j + 1], d[1][j + 1] = inf, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, m, cost = da.get(b[j - 1], 0), db, 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        da[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


@settings(max_examples=400, deadline=None)
@given(words, words, words)
def test_distance_is_a_metric(a, b, c):
    assert distance(a, b) == plain(a, b) == distance(b, a)
    assert distance(a, c) <= distance(a, b) + distance(b, c)
    assert (distance(a, b) == 0) == (a == b)


def test_many_distances_at_once():
    rng = random.Random(4)
    pairs = [["".join(rng.choice("abcé") for _ in range(rng.randint(0, 11))) for _ in "ab"] for _ in range(6000)]
    for i in range(0, 2000):  # near ones
        w = list(pairs[i][0])
        for _ in range(rng.randint(0, 3)):
            j = rng.randint(0, len(w))
            w[j : j + rng.randint(0, 2)] = rng.choice([[], ["a"], w[j : j + 2][::-1]])
        pairs[i][1] = "".join(w)
    (a, la), (b, lb) = (_codes([p[k] for p in pairs], 20) for k in (0, 1))
    assert distances(a, la, b, lb).tolist() == [distance(*p) for p in pairs]
    assert len(distances(a[:0], la[:0], b[:0], lb[:0])) == 0


def test_trees_find_all_within():
    rng = random.Random(1)
    names = {t: {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 8))) for _ in range(n)} for t, n in (("x", 300), (None, 40), ((), 1))}
    forest = BKForest({**names, "none": set()})
    asked = [(rng.choice(list(names)), "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11))), r) for _ in range(80) for r in (0, 1, 2)]
    for (t, q, r), got in zip(asked, forest.within(asked)):
        assert sorted(got) == sorted((distance(q, w), w) for w in names[t] if distance(q, w) <= r)
    assert forest.within([("none", "a", 2), ("other", "a", 2), ("x", "a" * 9000, 2)]) == [[], [], []] and BKForest({}).within([("x", "a", 2)]) == [[]]


CASES = [
    ("Saint Mídri", "AD", None), ("saint midri", "AD", 1), ("St. Mídri", "A.D.", 1), ("AD", "SAINT MÍDRI", 1), ("Pojuskirt", "", -1), ("pojuskirt", "NB", 3), ("Pojuskirt", "Greitrnuia", 3), ("Pojuskirt/GP", None, 2),
    ("cilix - prin", "dg", 4), ("City of Cilix-Prin", "DG", 4), ("Ciilx-Prin", None, 4), ("Up. Taegrolk (town)", "Thosen", 5), ("upper taegrolk wp", None, 5), ("Tefer", "Geiskuvu Coast", 6), ("Teefr", "VK", 6), ("Txfxr", "VK", -1),
    (None, None, -1), ("", "AD", -1), ("n/a", "n/a", -1), ("Ｔｅｆｅｒ", "VK", 6), ("T3fer", "VK", 6), ("nowhere at all", "AD", -1), ("x" * 5000, "AD", -1), ("🙂", "VK", -1), ("Tefer, old quarter", "VK", 6),
]


@pytest.mark.parametrize("shard_rows", [100, 4])
def test_mapping(spark, shard_rows):
    entries = spark.createDataFrame([(i, c, s, "z") for i, (c, s, _) in enumerate(CASES)] + [(900, "saint midri", "AD", "z")], "entry_id bigint, city string, state string, ref_id string")
    ref = spark.createDataFrame([(*r, "extra") for r in REF], "ref_id bigint, city string, state string, state_name string, typed string")
    got = {r.entry_id: r.ref_id for r in map_to_list(entries, "entry_id", "city", "state", ref, shard_rows, split_rows=3).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(CASES) if w is not None} | {900: 1}


def test_a_pair_that_most_entries_have(spark, monkeypatch):
    monkeypatch.setattr("depguard.plans.skew.HOT_PARTS", 3)
    entries = spark.createDataFrame([(i, "saint midri" if i % 2 else None, "AD" if i % 4 else None) for i in range(400)] + [(1000 + i, "Saint Mídri", "AD") for i in range(400)], "entry_id bigint, city string, state string")
    ref = spark.createDataFrame(REF, "ref_id bigint, city string, state string, state_name string")
    got = {r.entry_id: r.ref_id for r in map_to_list(entries, "entry_id", "city", "state", ref).collect()}
    assert got == {i: 1 if i % 2 else -1 for i in range(400)}


def test_empty(spark):
    ref = spark.createDataFrame([], "ref_id bigint, city string, state string, state_name string")
    e = spark.createDataFrame([(1, "a", "b")], "entry_id bigint, city string, state string")
    assert [tuple(r) for r in map_to_list(e, "entry_id", "city", "state", ref).collect()] == [(1, -1)]
    assert map_to_list(e.limit(0), "entry_id", "city", "state", ref).count() == 0


def test_fold():
    assert fold("  Ｓａｉｎｔ  M0ünt-d'Or ") == ["saint", "mount", "dor"] and radius("abc") == 0 and radius("abcde") == 1


@pytest.mark.parametrize("shard_rows", [1000, 4])
def test_shards_know_all_regions_and_rank_readings_alike(spark, shard_rows):
    ref, typed = [], []
    for i, x in enumerate("bcdfghjklmnp"):
        ref += [(10 * i, f"Kelm{x}ra", f"A{x}", f"Zonder{x}{x}{x}al"), (10 * i + 1, f"Kelm{x}rb", f"B{x}", f"Quist{x}{x}{x}um")]
        typed.append((f"Kelm{x}rc", f"Zonder{x}{x}{x}al", 10 * i))  # as near to the other city, which isn't in that region
        ref += [(10 * i + 2, f"Mar{x}land", f"C{x}", f"Nor{x}wood"), (10 * i + 3, f"Nor{x}wood", f"D{x}", f"Mar{x}land")]
        typed.append((f"Mar{x}land", f"Nor{x}wood", 10 * i + 2))  # as typed, or exchanged
    entries = spark.createDataFrame([(i, c, s) for i, (c, s, _) in enumerate(typed)], "entry_id bigint, city string, state string")
    df = spark.createDataFrame(ref, "ref_id bigint, city string, state string, state_name string")
    got = {r.entry_id: r.ref_id for r in map_to_list(entries, "entry_id", "city", "state", df, shard_rows).collect()}
    assert got == {i: r for i, (_, _, r) in enumerate(typed)}
