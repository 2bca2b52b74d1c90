import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from depguard.api import detect
from depguard.operators import dc, dd, fd, pod
from depguard.operators.components import connected_components
from depguard.operators.repair import CHANGED, VISITED, class_audit, repair, value_classes, vote
from depguard.rules import parse_rule

F1 = [
    (1, "200433", "Shanghai", "SH", "p1", 9000, 21), (2, "200433", "Shanghai", "SH", "p2", 12000, 21), (3, "200433", "Beijing", "SH", "p3", 16000, 21),
    (4, "100000", "Beijing", "BJ", "p4", 20000, 10), (5, "100000", "Beijing", "BJ", "p5", 8500, 10), (6, "100000", "Tianjin", "TJ", "p6", 15500, 22),
    (7, "100000", "Tianjin", "BJ", "p7", 30000, 22), (8, "300000", "Tianjin", "TJ", "p8", 18000, 22), (9, "400000", None, "CQ", "p9", 7000, 23),
    (10, "400000", "Chongqing", "CQ", "p10", 7600, 23), (11, None, "Wuhan", "HB", "p11", 9900, 27), (12, None, "Hubei", "HB", "p12", 9900, 27),
]
F2 = [("l", "x")] * 3 + [("l", None)] * 4 + [("l", "y"), (None, "z"), ("m", "q")]


@pytest.fixture(scope="module")
def addr(spark):
    return spark.createDataFrame(F1, "id int, zip string, city string, state string, phone string, salary int, areacode int").cache()


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame(F2, "l string, r string").cache()


def one(df):
    return tuple(df.first())


def test_fd(addr, nulls):
    rule = parse_rule("zip->city", "fd")
    assert one(detect(addr, rule))[:2] == (9, 12)
    assert sorted(r.id for r in detect(addr, rule, output="rows").collect()) == [1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert one(fd.fd_report(nulls, parse_rule("l->r", "fd")))[:2] == (8, 10)
    assert {tuple(r)[1:] for r in fd.rows_with_report(addr.select("id"), parse_rule("id->id", "fd")).collect()} == set()


def test_rollup_tells_null_from_subtotal(nulls):
    got = sorted((tuple(r) for r in fd.rollup_counts(nulls, "l", "r").collect()), key=str)
    want = [(None, None, 10, 3), (None, None, 1, 1), (None, "z", 1, 0), ("l", None, 8, 1), ("l", None, 4, 0), ("l", "x", 3, 0), ("l", "y", 1, 0), ("m", None, 1, 1), ("m", "q", 1, 0)]
    assert got == sorted(want, key=str)


def test_votes(addr, nulls):
    m = lambda df, l, r, k: sorted(map(tuple, vote(df, (l,), r, k).collect()))  # noqa: E731, E741
    assert m(addr, "zip", "city", "majority") == [("200433", "Shanghai")]
    assert m(addr, "zip", "city", "plurality") == [("100000", "Beijing"), ("200433", "Shanghai"), ("400000", "Chongqing")]
    assert m(nulls, "l", "r", "majority") == [] and m(nulls, "l", "r", "plurality") == [("l", "x")]
    with pytest.raises(ValueError):
        vote(addr, ("zip",), "city", "best")


def test_repair(addr, scratch):
    done = repair(addr, parse_rule("zip->city", "fd"), scratch, flags=True)
    rows = done.df.collect()
    assert sum(r[VISITED] for r in rows) == 9 and sorted(r.id for r in rows if r[CHANGED]) == [3, 6, 7, 9]
    assert one(done.report()) == (9, 12, "zip->city") and one(done.report(CHANGED))[0] == 4
    again = repair(done.df.select(*addr.columns), parse_rule("zip->city", "fd"), scratch)
    assert sorted(map(tuple, again.df.collect()), key=str) == sorted(map(tuple, done.df.select(*addr.columns).collect()), key=str)
    assert one(fd.before_after(addr, done.df, parse_rule("zip->city", "fd")))[:2] == (9, 0)


def test_shared_right_side(addr, scratch):
    done = repair(addr, parse_rule("zip->state;city->state", "fdset"), scratch, flags=True)
    rows = done.df.collect()
    assert sum(r[VISITED] for r in rows) == 8 and sorted(r.id for r in rows if r[CHANGED]) == [1, 2, 3, 6, 8]
    assert done.df.columns == [*addr.columns, VISITED, CHANGED]


def test_value_classes(addr, scratch):
    got = {r.zip: r.eqclass for r in value_classes(addr, "zip", "city", scratch).filter("zip is not null").collect()}
    assert got == {"200433": "100000", "100000": "100000", "300000": "100000", "400000": "400000"}
    audit = class_audit(value_classes(addr, "zip", "city", scratch), "state").collect()
    assert [(r.eqclass, r.n_values, r.n_rows) for r in audit] == [("100000", 3, 8)]


def test_cycle_is_reported(addr, scratch):
    assert sorted(repair(addr, parse_rule("zip->city;city->zip", "fdset"), scratch).unrepaired) == ["city", "zip"]


def test_mfd(addr):
    assert one(detect(addr, parse_rule("zip@city", "mfd")))[:2] == (6, 66)
    assert one(detect(addr, parse_rule("zip,state@city", "mfd")))[:2] == (4, 66)
    assert detect(addr, parse_rule("zip,state@city", "mfd"), "id", "pairs").count() == 4


def test_dc(addr):
    r = lambda text, **k: one(dc.dc_report(addr, parse_rule(text, "dc"), "id", **k))
    base = "A.city=B.city@A.zip!=B.zip"
    assert r(base)[:3] == (4, 66, 8)
    assert r(base + "@A.salary>15000")[2] == 7 and r(base + "@A.salary>15000", both_sides=True)[2] == 6
    assert [tuple(x)[0::4] for x in dc.pairs(addr, parse_rule("A.zip=B.zip@A.salary>B.salary@A.areacode<B.areacode", "dc"), "id").select("A_id", "A_zip", "A_salary", "A_areacode", "B_id").collect()] == [(4, 6)]
    assert r("A.salary>15000")[:2] == (5, 12)
    assert r(base, clamp=True)[:2] == (8, 132)
    assert sorted(x.id for x in detect(addr, parse_rule("A.zip=B.zip@A.salary>B.salary@A.areacode<B.areacode", "dc"), "id", "rows").collect()) == [4, 6]


def test_dd(addr):
    n = lambda text, **k: one(dd.dd_report(addr, parse_rule(text, "dd"), "id", **k))[:2]
    for k in ({}, {"strategy": "grid", "grid": 3}):
        assert n("salary<2000@areacode<5", **k) == (7, 66)
        assert n("salary<5000,salary>1000@areacode<5", **k) == (9, 66)
        assert n("salary<2000@areacode>=5", **k) == (4, 66)


def test_pod(spark):
    s = "id int, a1 int, a2 int, c int"
    base = spark.createDataFrame([(1, 10, 100, 50), (2, 20, 90, 60), (3, 30, 120, 55), (4, 40, 130, 90), (5, 20, 90, 60), (6, 50, 140, 80)], s)
    add = spark.createDataFrame([(101, 35, 125, 52), (102, 15, 95, 70), (103, 60, 150, 60), (104, 20, 90, 60)], s)
    rule = parse_rule("[a1>][a2>]->[c>]", "pod")
    want = {(101, 2), (101, 3), (101, 5), (102, 3), (103, 2), (103, 4), (103, 5), (103, 6), (104, 3)}
    got = pod.pod_incremental(base, add, rule, "id").collect()
    assert {(r.add_id, r.base_id) for r in got} == want and len(got) == len(want)
    assert {(r.id, r.rep) for r in pod.representatives(base, ["a1", "a2", "c"], "id").collect()} == {(i, 2 if i == 5 else i) for i in range(1, 7)}
    assert pod.pod_incremental(base.limit(0), add, rule, "id").count() == 0 and pod.pod_incremental(base, add.limit(0), rule, "id").count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(-5, 5))), max_size=24))
def test_rewrites_equal_all_pairs(spark, rows):
    data = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, x int, y int, z int")
    pairs = [(a, b) for a in data for b in data if a[0] < b[0]]
    eq = lambda a, b: a is not None and b is not None and a == b
    ne = lambda a, b: a is not None and b is not None and a != b
    mfd = sum(eq(a[1], b[1]) and ne(a[2], b[2]) for a, b in pairs)
    assert one(detect(df, parse_rule("x@y", "mfd")))[0] == mfd == detect(df, parse_rule("x@y", "mfd"), "id", "pairs").count()
    near = sum(a[3] is not None and b[3] is not None and abs(a[3] - b[3]) <= 2 and a[1] is not None and b[1] is not None and not abs(a[1] - b[1]) < 2 for a, b in pairs)
    assert dd.dd_pairs(df, parse_rule("z<=2@x<2", "dd"), "id").count() == near
    assert one(dd.dd_report(df, parse_rule("z<=2@x<2", "dd")))[0] == near
    lt = lambda a, b: a is not None and b is not None and a < b
    for text, p in (
        ("A.x=B.x@A.y<=B.y", lambda a, b: eq(a[1], b[1]) and (eq(a[2], b[2]) or lt(a[2], b[2]))),
        ("A.z<B.z@A.y>0", lambda a, b: lt(a[3], b[3]) and a[2] is not None and a[2] > 0),
        ("A.x!=B.y@B.z=1", lambda a, b: ne(a[1], b[2]) and eq(b[3], 1)),
        ("A.x=B.y", lambda a, b: eq(a[1], b[2])),
    ):
        ordered = sum(p(a, b) for a in data for b in data if a is not b)
        either = sum(p(a, b) or p(b, a) for a, b in pairs)
        assert one(dc.dc_report(df, parse_rule(text, "dc")))[:3] == (either, len(pairs), ordered), text
        assert dc.pairs(df, parse_rule(text, "dc"), "id").count() == ordered
    rule = parse_rule("[x>][y>=]->[z>]", "pod")
    t, s = [r for r in data if r[0] % 3 == 0], [r for r in data if r[0] % 3]

    def bad(t, s):
        if None in t or None in s:
            return False
        return t[1] > s[1] and t[2] >= s[2] and t[3] <= s[3] or t[1] < s[1] and t[2] <= s[2] and t[3] >= s[3]

    got = pod.pod_incremental(df.filter("id % 3 <> 0"), df.filter("id % 3 = 0"), rule, "id", stripes=4)
    assert sorted((r.add_id, r.base_id) for r in got.collect()) == sorted((a[0], b[0]) for a in t for b in s if bad(a, b))


def test_components_of_chains_and_hubs(spark, scratch):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 302)]
    rng.shuffle(edges)
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 300, 301: 300, 302: 300}
    for one_task in (0, 1000):
        got = [tuple(r) for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"), scratch, one_task=one_task).collect()]
        assert dict(got) == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint"), scratch).count() == 0
    words = connected_components(spark.createDataFrame([("b", "a"), ("b", "c"), ("z", "z")], "src string, dst string"), scratch)
    assert sorted(map(tuple, words.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("z", "z")]


def test_empty_tables(addr, scratch):
    none = addr.limit(0)
    for text, family in (("zip->city", "fd"), ("zip@city", "mfd"), ("A.zip=B.zip@A.salary>B.salary", "dc"), ("A.salary>1", "dc"), ("A.salary>B.salary", "dc"), ("salary<5@areacode<5", "dd"), ("salary>5@areacode<5", "dd")):
        assert one(detect(none, parse_rule(text, family), "id"))[:2] == (0, 0), text
    assert detect(none, parse_rule("salary<5@areacode<5", "dd"), "id", "pairs").count() == 0
    for rules in ("zip->city", "zip->city;city->state", "zip->state;city->state"):
        done = repair(none, parse_rule(rules, "fdset"), scratch)
        assert done.df.count() == 0 and one(done.report())[:2] == (0, 0)
    with pytest.raises(ValueError):
        detect(addr, parse_rule("zip@city", "mfd"), output="pairs")
    with pytest.raises(ValueError):
        detect(addr, parse_rule("zip->city", "fd"), "id", "pairs")


def test_repeated_rows_and_types(spark, scratch):
    df = spark.createDataFrame([(1, 1.5, None), (1, 1.5, None), (1, 2.5, None), (None, 3.5, None)], "k int, v double, w string")  # names used inside elsewhere
    assert one(detect(df, parse_rule("k->v", "fd")))[:2] == (3, 4)
    assert sorted(r.v for r in repair(df, parse_rule("k->v", "fd"), scratch).df.collect()) == [1.5, 1.5, 1.5, 3.5]
    assert one(detect(df, parse_rule("k->w", "fd")))[:2] == (0, 4)  # one value: null
    assert one(repair(df, parse_rule("v->k", "fd"), scratch).report())[0] == 0


def test_columns_named_like_ours(spark, scratch):
    df = spark.createDataFrame([(1, 1, 1, 1, 1), (1, 2, 1, 2, 2), (2, 2, 1, 1, 3), (2, 2, 3, 1, 4)], "n int, w int, k int, node int, id int")
    assert one(detect(df, parse_rule("n->w", "fd")))[:2] == (2, 4) and one(detect(df, parse_rule("n@w", "mfd")))[0] == 1
    assert one(detect(df, parse_rule("A.n=B.n@A.w<B.w", "dc")))[:3] == (1, 6, 1) and one(detect(df, parse_rule("k<1@w<1", "dd")))[0] == 2
    assert repair(df, parse_rule("n->node;k->node", "fdset"), scratch).df.count() == 4
    assert value_classes(df, "n", "node", scratch).select("eqclass").distinct().count() == 1
