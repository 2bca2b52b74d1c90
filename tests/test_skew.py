"""How rows are spread: one value with a third of all rows, one just under the limit of hot values."""

import random
import re
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from depguard.api import detect
from depguard.operators import dc, dd, fd
from depguard.operators.repair import repair
from depguard.plans.dominance import count_ordered, inversions
from depguard.plans.pairs import grid_side, order_join, sides
from depguard.plans.skew import HOT_PARTS, fragment_join, hot_cuts, hot_keys, hot_parts, spread_join
from depguard.report import as_count
from depguard.rules import parse_rule

N = 40_000


@pytest.fixture
def plain_shuffles(spark):
    """Joins by shuffle into 16 partitions, as they come."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def skewed(spark, n=N):
    """id, k, v: k is hot for 30 % of the rows, warm for just under 1/HOT_PARTS, null for 10 %, else one of many values."""
    k = F.when(F.col("id") < 0.3 * n, "hot").when(F.col("id") < 0.3 * n + n // HOT_PARTS - 1, "warm").when(F.col("id") >= 0.9 * n, None).otherwise(F.concat(F.lit("k"), F.col("id") % 3001))
    return spark.range(n).repartition(8, "id").select("id", k.alias("k"), (F.col("id") % 7).alias("v"))


def loads(df):
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_more_parts_with_more_partitions(spark, plain_shuffles):
    assert hot_parts(spark) == HOT_PARTS
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    assert hot_parts(spark) == 4000


def test_spread_join_is_even(spark, plain_shuffles):
    left = skewed(spark)
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, ["k"], "n", N)
    assert [r.k for r in hot.collect()] == ["hot"]
    out = spread_join(left, counts, ["k"], hot)
    n = loads(out)
    assert sum(n) == N and max(n) < 3 * median(n)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, left.join(counts, "k", "left").select("id", "k", "v", "n").collect()), key=str)


def test_pairs_are_even(spark, plain_shuffles, scratch):
    df = skewed(spark, 3000)
    pairs = fd.mfd_pairs(df, parse_rule("k@v", "mfd"), "id", scratch)
    n = loads(pairs)
    assert sum(n) == fd.mfd_report(df, parse_rule("k@v", "mfd")).first().dirty > 300_000 and max(n) < 3 * median(n) and len(n) == 16
    rule = parse_rule("A.k=B.k@A.v<B.v", "dc")
    n = loads(dc.pairs(df, rule, "id", scratch=scratch))
    assert sum(n) == sum(loads(pairs)) and max(n) < 3 * median(n) and len(n) == 16


def test_near_pairs_are_even(spark, plain_shuffles):
    df = spark.range(3000).select("id", F.when(F.col("id") < 900, 5.0).otherwise(F.col("id") * 3.0).alias("x"), (F.col("id") % 50).cast("double").alias("y"))
    n = loads(dd.dd_pairs(df, parse_rule("x<2@y<25", "dd"), "id"))
    assert sum(n) == dd.dd_report(df, parse_rule("x<2@y<25", "dd")).first().dirty > 90_000 and max(n) < 3 * median(n) and len(n) == 16


def test_rows_and_repairs_of_a_hot_value(spark, scratch):
    df, rule = skewed(spark, 6000), parse_rule("k->v", "fd")
    assert detect(df, rule, output="rows").count() == fd.fd_report(df, rule).first().dirty
    done = repair(df, rule, scratch, flags=True)
    assert done.df.count() == 6000 and done.report().first().dirty == fd.fd_report(df, rule).first().dirty
    assert fd.fd_report(done.df.select("id", "k", "v"), rule).first().dirty == 0


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_fragments_equal_a_join(spark, how):
    rng = random.Random(3)
    a = spark.createDataFrame([(i, rng.choice(["h"] * 5 + list("abc") + [None]), i % 5) for i in range(300)], "i int, k string, x int")
    b = spark.createDataFrame([(i, rng.choice(["h"] * 5 + list("abd") + [None]), i % 4) for i in range(200)], "j int, k string, y int")
    cuts = hot_cuts(a.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", 300, 6)
    assert cuts.first()["__cuts"] > 1
    on = F.col("x") < F.col("y")
    got = fragment_join(a, b, ["k"], cuts, F.xxhash64("i"), on, how)
    want = a.join(b.withColumnRenamed("k", "kk"), (F.col("k") == F.col("kk")) & on, how).drop("kk")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_order_join_meets_every_pair(spark, op):
    rng = random.Random(op)
    data = [(i, rng.choice([None, 5.0, 5.0, 5.0, rng.uniform(-9, 9), float("inf")])) for i in range(160)]
    a, b = sides(spark.createDataFrame(data, "id int, x double"), ["id", "x"])
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    want = sorted((i, j) for i, x in data for j, y in data if None not in (x, y) and test(x, y))
    for side in (1, 2, 7, None):
        on = {"<": F.col("A_x") < F.col("B_x"), "<=": F.col("A_x") <= F.col("B_x"), ">": F.col("A_x") > F.col("B_x"), ">=": F.col("A_x") >= F.col("B_x")}[op]
        got = order_join(a, b, "A_x", op, "B_x", "A_id", "B_id", side, on)
        assert sorted((r.A_id, r.B_id) for r in got.collect()) == want
        members = order_join(a, b, "A_x", op, "B_x", "A_id", "B_id", side, on, "left_semi")
        assert {r.A_id for r in members.collect()} == {i for i, _ in want}
    assert grid_side(a.limit(0), b.limit(0)) > 1 and order_join(a.limit(0), b, "A_x", op, "B_x", "A_id", "B_id", None, on).count() == 0


@pytest.mark.parametrize("text", ["A.k=B.k@A.v>B.v", "A.v>B.v@B.id<50", "A.v!=B.v@A.id>290", "A.k=B.k@A.id<9"])
def test_members_of_pairs(spark, scratch, text):
    df, rule = skewed(spark, 300), parse_rule(text, "dc")
    p = dc.pairs(df, rule, "id").collect()
    assert {r.id for r in detect(df, rule, "id", "rows").collect()} == {r[c] for r in p for c in ("A_id", "B_id")}
    assert detect(df, rule, "id", "rows").columns == df.columns


def test_counts_beyond_bigint(spark):
    big = spark.sql("SELECT CAST('9223372036854775808' AS DECIMAL(38,0)) AS n")
    assert str(big.select(as_count(F.col("n"), True).alias("n")).first().n) == "9223372036854775808"
    assert big.select(as_count(F.col("n") - 1).alias("n")).first().n == 2**63 - 1
    with pytest.raises(Exception, match="exact=True"):
        big.select(as_count(F.col("n"))).collect()
    df = spark.createDataFrame([(1, 1), (1, 2)], "x int, y int")
    assert dict(detect(df, parse_rule("x@y", "mfd"), exact=True).dtypes)["dirty"] == "decimal(38,0)" and detect(df, parse_rule("x@y", "mfd"), exact=True).first().dirty == 1


def test_inversions():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 17, 64, 300):
        keys, wa, wb = ([rng.randrange(top) for _ in range(n)] for top in (max(n, 1), 4, 4))
        want = sum(wa[p] * wb[q] for q in range(n) for p in range(q) if keys[p] > keys[q])
        assert inversions(*(np.array(x, np.int64) for x in (keys, wa, wb))) == want
    assert inversions(np.array([3, 1, 2]), *[np.array([2**62, 2**61, 2**61])] * 2) == 2**62 * 2**62


@pytest.mark.parametrize("ops", ["><", "<=>", ">=>="])
def test_ordered_pairs_are_counted(spark, scratch, ops):
    x, y = re.findall("[<>]=?", ops)
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    rng = random.Random(ops)
    data = [(rng.choice([None, *range(9)]), rng.choice([None, float("inf"), *range(40)]), rng.choice(["1", "2.0", "2", "x"])) for _ in range(220)]
    df = spark.createDataFrame([(a, b if b is None else float(b), c) for a, b, c in data], "x int, y double, z string")
    ok = lambda s, t: None not in (s[0], s[1], t[0], t[1]) and test[x](s[0], t[0]) and test[y](s[1], t[1])
    for more, own in (("", lambda s, t: True), ("@A.y>5@B.y<30", lambda s, t: s[1] > 5 and t[1] < 30)):
        bad = lambda s, t: ok(s, t) and own(s, t)  # noqa: B023, E731
        ordered = sum(bad(s, t) for i, s in enumerate(data) for j, t in enumerate(data) if i != j)
        either = sum(bad(s, t) or bad(t, s) for i, s in enumerate(data) for t in data[:i])
        rule, itself = parse_rule(f"A.x{x}B.x@A.y{y}B.y{more}", "dc"), sum(bad(s, s) for s in data)
        assert tuple(dc.dc_report(df, rule).first())[:3] == (either, 220 * 219 // 2, ordered)
        if more:
            assert tuple(dc.dc_report(df, rule, self_pairs=True).first())[::2] == (either, ordered + itself)
    points = df.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("x").alias("__x"), F.col("y").alias("__y")).agg(F.count("*").alias("__wa"), F.count("*").alias("__wb"))
    n = lambda stripes: count_ordered(scratch.write(points, "points"), x, y, scratch, stripes).agg(F.sum("n")).first()[0]
    want = sum(ok(s, t) and s[:2] != t[:2] for s in data for t in data)
    assert n(1) == n(13) == want


def test_ordered_numbers_in_text(spark):
    df = spark.createDataFrame([("1",), ("2.0",), ("2",), ("10",), ("x",), (None,)], "z string")
    assert tuple(dc.dc_report(df, parse_rule("A.z>B.z", "dc"), numeric=frozenset({"z"})).first())[:3] == (5, 15, 5)
    assert tuple(dc.dc_report(df, parse_rule("A.z>=B.z", "dc"), numeric=frozenset({"z"})).first())[:3] == (6, 15, 7)
    assert dc.dc_report(df, parse_rule("A.z>B.z", "dc")).first().dirty == 10


def test_report_of_order_forms_no_pair(spark, plain_shuffles):
    """Six billion comparisons of 110,000 classes; no join of rows is planned."""
    df = spark.range(110_000).select((F.col("id") * 7919 % 110_000).alias("x"), (F.col("id") * 104_729 % 110_000).alias("y"))
    x, y = (np.arange(110_000) * k % 110_000 for k in (7919, 104_729))
    by = y[np.argsort(x)]
    want = inversions(by, *[np.ones(110_000, np.int64)] * 2)
    report = dc.dc_report(df, parse_rule("A.x>B.x@A.y<B.y", "dc"))
    assert "SortMergeJoin" not in report._jdf.queryExecution().toString() and report.first().ordered_pairs == want


@pytest.fixture(scope="module")
def near_and_far(spark):
    rng = random.Random(7)
    data = [(i % 190, rng.choice([None, 5.0, 5.0, rng.uniform(-9, 9), rng.uniform(-9, 9), -3.0, float("inf"), float("nan")]), i % 11) for i in range(200)]  # some keys come twice
    return spark.createDataFrame(data, "id int, x double, y int").cache()


def same_as_all_pairs(df, text, **k):
    rule = parse_rule(text, "dd")
    a, b = sides(df, ["id", "x", "y"])
    want = a.join(b, (F.col("A_id") < F.col("B_id")) & dd._conditions(rule)).select("A_id", "B_id", "A_y", "B_y")
    got = dd.dd_pairs(df, rule, "id", **k)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert dd.dd_report(df.drop_duplicates(["id"]), rule, **k).first().dirty == dd.dd_pairs(df.drop_duplicates(["id"]), rule, "id", **k).count()


@pytest.mark.parametrize(("text", "grid"), [("x>7@y<4", 9), ("x>=8@y<4", None), ("x>100@y<4", 1), ("y>5,x>7@y<8", 5)])
def test_far_pairs_equal_all_pairs(near_and_far, text, grid):
    same_as_all_pairs(near_and_far, text, grid=grid)


def test_far_pairs_meet_where_they_can(spark, plain_shuffles, monkeypatch):
    """All pairs of 50,000 rows aren't compared, only lines of which one may be far from the other."""
    monkeypatch.setattr(dd, "grid_join", None)
    df = spark.range(50_000).select("id", (F.col("id") * 7919 % 50_000).cast("double").alias("x"), F.lit(1).alias("y"))
    n = loads(dd.dd_pairs(df, parse_rule("x>48000@y>0", "dd"), "id"))
    assert sum(n) == 1999 * 2000 // 2 and len(n) > 1


@pytest.mark.parametrize(("text", "grid"), [("x<0.5@y<4", 9), ("x<=8,x>2@y<4", None), ("x=8@y>4", 3), ("y!=3@y<5", 4)])
def test_near_pairs_of_a_grid_equal_all_pairs(near_and_far, text, grid):
    same_as_all_pairs(near_and_far, text, grid=grid, strategy="grid")


def test_near_pairs_of_a_grid_meet_where_they_can(spark, plain_shuffles, monkeypatch):
    """Lines far from each other aren't compared, and all tasks have about as many pairs."""
    monkeypatch.setattr(dd, "grid_join", None)
    df = spark.range(20_000).select("id", (F.col("id") * 7919 % 20_000).cast("double").alias("x"), F.lit(1).alias("y"))
    n = loads(dd.dd_pairs(df, parse_rule("x<200@y>0", "dd"), "id", strategy="grid"))
    assert sum(n) == 199 * 20_000 - 199 * 200 // 2 and len(n) == 16 and max(n) < 3 * median(n)
