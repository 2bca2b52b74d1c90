import random
import re

import pytest
from pyspark.sql import functions as F

from depguard.operators.heavy import per_key_report
from depguard.operators.impute import Category, Number, chained_imputation, real_code, real_name
from depguard.operators.malformed import Field, LineSchema, check_lines, int_pattern, load_lines
from depguard.plans.skew import hot_join, hot_keys, place, spread_join

SCHEMA = LineSchema([Field("zip"), Field("city", "name"), Field("state"), Field("phone"), Field("salary", "int"), Field("areacode")])


def brute_reason(line):
    if line is None:
        return "columns"
    fields, at = [], 0
    while True:
        m = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?=,|\Z)').match(line, at)
        if not m:
            return "quoting"
        fields.append(m[0])
        at = m.end()
        if at == len(line):
            break
        at += 1
    if len(fields) != 6:
        return "columns"
    plain = [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in fields]
    if not any(c.isalpha() for c in plain[1]) or "�" in plain[1]:
        return "value"
    s = plain[4].strip(" \t")
    if s and not (re.fullmatch("-?[0-9]+", s) and -(2**31) <= int(s) < 2**31):
        return "value"
    return None


def test_int_pattern():
    p = re.compile(int_pattern(-(2**31), 2**31 - 1))
    for n in ("0", "-0", "007", "2147483647", "-2147483648", "00002147483647", "1999999999", "2099999999", "999999999"):
        assert p.fullmatch(n), n
    for n in ("", "-", "2147483648", "-2147483649", "99999999999", "3000000000", "1e4", "+5", "１２"):
        assert not p.fullmatch(n), n


LINES = [
    "1,Rome,X,p,5,9", '1,"Rome",X,p,5,9', '1,"Ro""me",X,p,5,9', '1,"Rome "Old"",X,p,5,9', '1,Ro"me,X,p,5,9', '1,"Rome,X,p,5,9', "1,Rome,X,p,5", "1,Rome,X,p,5,9,", "", None,
    ",,,,,", '"","","","","",""', '1,"""Rome""",X,p,5,9', '1,""Rome,X,p,5,9', '1,"a,b",X,p,5,9', '1,"a\nb",X,p, 5\t,9', "1,77,X,p,5,9", "1,R�m,X,p,5,9", "1,Rome,X,p,,9", "1,Rome,X,p,2147483648,9",
    '1,Rome,X,p,"7 ",9', '1,Rome,X,p,"4,800",9', '1,Rome,X,p,"5"0,9', "1,Rome,X,p,0x1b,9", "1,Rome,X,p,-12,9", '""""', '"', '"""', "a\nb", "1,Rome\n,X,p,5,9\n", '1,"Rome"",X,p,5,9', "é,Évora,,,,", '1,Rome,X,p,5,"9"x',
    "1,Rome,X,p,１２,9", '1,"""",X,p,5,9', '1,Rome,"",p,"",9', "x" * 100_000, '1,"' + '""' * 60_000 + 'a",X,p,5,9', "," * 50_000, '"a",' * 20_000 + '"',
]


def test_lines_against_a_parser(spark):
    rng = random.Random(5)
    lines = LINES + ["".join(rng.choice('",ab1 \n') for _ in range(rng.randint(0, 24))) for _ in range(600)] + [",".join(rng.choice(['a', '""', '"a"', '"a,b"', '1', '"x""y"', 'a"', '""a"']) for _ in range(6)) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(lines)), "no int, line string")
    got = {r.no: r.reason for r in check_lines(df, "line", SCHEMA).collect()}
    assert {i: got[i] for i in range(len(lines))} == {i: brute_reason(x) for i, x in enumerate(lines)}


def test_valid_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, '1,"Ro""me, IT",X,p, 7 ,"9"', "x", "c"), (2, "", "y", "c"), (3, '1,"""Q""","",,,', "z", "c")], "no int, line string, city string, feed string")
    good, bad = load_lines(df, "line", SCHEMA)
    rows = {r.no: r for r in good.collect()}
    assert rows[1].city == 'Ro"me, IT' and rows[1].salary == 7 and rows[1].areacode == "9" and rows[1].feed == "c"
    assert rows[3].city == '"Q"' and rows[3].state == "" and rows[3].salary is None
    assert [(r.no, r.reason, r.broken_field, r.city) for r in bad.collect()] == [(2, "columns", 2, "y")]
    assert all(x.count() == 0 for x in load_lines(df.limit(0), "line", SCHEMA))


def test_first_broken_field(spark):
    lines = [('1,"Rome,X,p,5,9', 2), ("1,Rome,X,p,x,9", 5), ("1,Rome,X,p,5,9,7", 7), ('1,77,X,"p,5,9', 4), ("1,77,X,p,x", 6), ("", 2), ('1,Rome,X,p,5,9,a,"b', 7), ("1,,X,p,x,9", 2), (None, 1)]
    df = spark.createDataFrame([(x,) for x, _ in lines], "line string")
    assert [r.broken_field for r in check_lines(df, "line", SCHEMA).collect()] == [n for _, n in lines]


def test_markers_in_a_line_stay_as_they_are(spark):
    texts = ["\uffff", "\ufffe", "\uffff\ufffe0\uffff1", "\ufffe1\ufffe0", 'a\uffff"b\ufffe']
    lines = [(i, '1,Rome,"' + x.replace('"', '""') + '",' + x.replace('"', "") + ",7,") for i, x in enumerate(texts)] + [(9, "1,\uffff\ufffe1,,,,")]
    good, bad = load_lines(spark.createDataFrame(lines, "no int, line string"), "line", SCHEMA)
    assert {r.no: (r.state, r.phone) for r in good.collect()} == {i: (x, x.replace('"', "")) for i, x in enumerate(texts)}
    assert [(r.no, r.reason, r.line) for r in bad.collect()] == [(9, "value", "1,\uffff\ufffe1,,,,")]


def test_reasons_come_through_the_prefix_patterns(spark, small):
    from depguard.queries.cleaning import QUERIES

    plan = QUERIES["p4_found"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert all(p in plan for p in (*SCHEMA.shapes, *SCHEMA.prefixes))


@pytest.mark.parametrize("slots", [1, 3, 8])
def test_per_key_report(spark, scratch, slots):
    rng = random.Random(1)
    rows = [("hot", rng.choice(["a", "b", None])) for _ in range(700)] + [(f"k{rng.randint(0, 60)}", rng.choice("abc")) for _ in range(500)] + [("nul", None)] * 5 + [(None, "x")] * 9 + [("tie", "q"), ("tie", "p")]
    got = {r.key_value: (r.n, r.dirty, r.vote) for r in per_key_report(spark.createDataFrame(rows, "k string, d string"), "k", "d", scratch, slots).collect()}
    want = {}
    for k in {r[0] for r in rows} - {None}:
        ds = [d for x, d in rows if x == k]
        known = sorted({d for d in ds if d is not None}, key=lambda d: (-ds.count(d), d))
        want[k] = (len(ds), len(ds) - ds.count(known[0]) if known else 0, known[0] if known else None)
    assert got == want
    assert per_key_report(spark.createDataFrame([], "k string, d string"), "k", "d", scratch, slots).count() == 0


def test_placement_is_balanced(spark):
    loads = spark.createDataFrame([("hot", 3000), ("warm", 900), *((f"k{i}", 10) for i in range(600))], "k string, n bigint")
    p = place(loads, "k", "n", 10)
    used = [0.0] * 10
    for r in p.mark(loads).withColumn("s", p.shards()).collect():
        for s in r.s:
            used[s] += r.n / len(r.s)
    assert max(used) < 1.35 * sum(used) / 10
    assert len({s for r in p.table.filter("k = 'hot'").collect() for s in r._slots}) >= 3


def test_hot_join_equals_join(spark):
    left = spark.createDataFrame([(i, "h" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i int, k string")
    right = spark.createDataFrame([("h", 1), ("k3", 2), ("k6", 3)], "k string, v int")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, ["k"], "n", 301, 4)
    assert [r.k for r in hot.collect()] == ["h"]
    for known in (hot, None):
        assert sorted(map(str, spread_join(left, right, ["k"], known).select("k", "i", "v").collect())) == sorted(map(str, left.join(right, ["k"], "left").select("k", "i", "v").collect()))
    for how in ("inner", "left", "left_semi"):
        a, b = (sorted(map(str, x.collect())) for x in (hot_join(left, right, ["k"], hot, how), left.join(right, ["k"], how)))
        assert a == b


def test_real_values(spark):
    names = [("Kamoth", True), ("n/a", False), (" N.A. ", False), (None, False), ("  ", False), ("--", False), ("Ny", True), ("xxx", False), ("(unknown)", False), ("Not  Available", True), ("Åsa", True), ("12", False)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n, _ in names], "c string").select("c", real_name(F.col("c"))).collect()}
    assert got == dict(names)
    codes = [("123456", True), ("000000", False), ("12345", False), ("1234567", False), (None, False), ("123456\n", False), (" 12345", False), ("１２３４５６", False)]
    assert {r[0]: r[1] for r in spark.createDataFrame([(n,) for n, _ in codes], "c string").select("c", real_code(F.col("c"))).collect()} == dict(codes)


HOSPITAL = [
    (1, "123456", "Roma", "A", 5.0), (2, "123456", "Roma", "A", 7.0), (3, "123456", "n/a", "A", None), (4, None, "Roma", "A", 1.0), (5, "654321", "B", "A", 2.0), (6, "654321", "A", "A", 2.0),
    (7, "654321", None, None, None), (8, "000000", "Roma", None, 3.0), (9, None, None, "A", None), (10, "999998", "?", "A", None), (11, "-", "Nowhere", "A", 1.0),
]


def _real():
    return {"city": F.regexp_like("city", F.lit(r"\p{L}")) & ~F.col("city").isin("n/a"), "zip": real_code(F.col("zip"))}


def test_imputation_from_observed(spark, scratch):
    df = spark.createDataFrame(HOSPITAL, "id int, zip string, city string, state string, score double")
    out = {r.id: r for r in chained_imputation(df, "id", [Category("city", ("zip",)), Category("zip", ("city", "state"))], _real(), scratch, rounds=1).collect()}
    assert out[3].city == "Roma" and out[3].city_filled and not out[3].zip_filled
    assert out[4].zip == "123456" and out[4].zip_filled
    assert out[7].city == "A" and out[7].city_filled  # a tie: the smallest
    assert not out[8].zip_filled and not out[9].city_filled and out[10].city is None and out[11].zip is None
    assert not out[1].city_filled and out[1].city == "Roma"


def test_chained_rounds_noise_and_draws(spark, scratch):
    rows = [(i, "g1" if i % 2 else "g2", "ab"[i % 3 == 0] if i % 7 else None, float(i % 2 * 100 + i % 5) if i % 11 else None) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "id int, g string, c string, v double")
    eqs = [Category("c", ("g",), draw=True), Number("v", ("g",))]
    out = {r.id: r for r in chained_imputation(df, "id", eqs, {}, scratch, rounds=2).collect()}
    filled = [r for r in out.values() if r.c_filled]
    assert len(filled) == 57 and {r.c for r in filled} == {"a", "b"}  # drawn, not all the mode
    numbers = [r for r in out.values() if r.v_filled]
    assert len(numbers) == 36 and all(abs(r.v - (102 if r.g == "g1" else 2)) < 12 for r in numbers) and len({r.v for r in numbers}) > 30
    assert all(out[r[0]].v == r[3] for r in rows if r[3] is not None)
    empty = chained_imputation(df.limit(0), "id", eqs, {}, scratch)
    assert empty.count() == 0


def test_clashing_names_change_nothing(spark, scratch):
    df = spark.createDataFrame([(*r, "x", "y", 1, "r") for r in HOSPITAL], "id int, zip string, city string, state string, score double, __n string, _k string, n int, reason string")
    eqs = [Category("city", ("zip",)), Category("zip", ("city", "state"), draw=True), Number("score", ("zip",))]
    out = chained_imputation(df, "id", eqs, _real(), scratch)
    assert out.count() == len(HOSPITAL) and {"_k", "n", "city_filled", "city_missing"} <= set(out.columns)
    assert {r.key_value: r.n for r in per_key_report(df, "zip", "n", scratch).collect()}["123456"] == 3
    lines = spark.createDataFrame([("1,Rome,X,p,5,9", "mine", 1), ("", "mine", 2)], "line string, reason string, _coded int")
    good, bad = load_lines(lines, "line", SCHEMA)
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["columns"]


def test_one_equation_a_field(spark, scratch):
    with pytest.raises(ValueError):
        chained_imputation(spark.createDataFrame(HOSPITAL, "id int, zip string, city string, state string, score double"), "id", [Category("city", ("zip",)), Category("city", ("state",))], {}, scratch)


def test_a_weaker_predictor_never_replaces_a_stronger_one(spark, scratch):
    rows = [(1, "111112", "Ada", "H1"), (2, "111112", "Ada", "H2"), (3, "222223", "Bex", "H1"), (4, "222223", "Bex", "H1"), (5, "111112", None, "H1"), (6, None, "Ada", "H1"), (7, None, None, "H1"), (8, None, None, "H9"), (9, "333334", None, "H2"), (10, "333334", None, None), (11, "222223", "Bex", "H1")]
    df = spark.createDataFrame(rows, "id int, zip string, city string, hname string")
    eqs = [Category("city", (("zip",), ("hname",))), Category("zip", (("city",), ("hname",)))]
    for rounds in (1, 2, 3):
        out = {r.id: r for r in chained_imputation(df, "id", eqs, {}, scratch, rounds).collect()}
        assert (out[5].city, out[5].city_by) == ("Ada", "zip") and (out[6].zip, out[6].zip_by) == ("111112", "city")
        assert (out[7].city, out[7].city_by, out[7].zip, out[7].zip_by) == ("Bex", "hname", "222223", "hname")
        assert (out[8].city, out[8].city_by, out[8].city_filled) == (None, None, False) and (out[9].city, out[9].city_by) == ("Ada", "hname")
        assert out[10].city is None and out[10].city_missing
    linked = spark.createDataFrame([(1, "a", "p", None), (2, "a", None, "q")], "id int, x string, y string, z string")
    out = {r.id: r for r in chained_imputation(linked, "id", [Category("y", ("x",)), Category("z", ("y",))], {}, scratch).collect()}
    assert (out[2].y, out[2].y_by) == ("p", "x") and (out[1].z, out[1].z_by) == ("q", "~y")  # told by a record whose y was filled


def _chain(rows, equations, rounds):
    """The same by brute force: (field, sets of predictors) in turn; values of observed predictors and records first."""
    for r in rows:
        r["by"] = {}
    for _ in range(rounds):
        for field, sets in equations:
            told = []
            for by in sets:
                sure, other = {}, {}
                for r in rows:
                    if not r["missing"][field] and None not in (k := tuple(r[b] for b in by)):
                        c = (other if any(r["missing"][b] for b in by) else sure).setdefault(k, {})
                        c[r[field]] = c.get(r[field], 0) + 1
                mode = lambda c: min(c, key=lambda v: (-c[v], v))
                told.append(({k: mode(c) for k, c in sure.items()}, {k: mode(c) for k, c in other.items() if k not in sure}))
            for r in [r for r in rows if r["missing"][field]]:
                best = []
                for i, (by, (sure, other)) in enumerate(zip(sets, told)):
                    k = tuple(r[b] for b in by)
                    if None in k or (k not in sure and k not in other):
                        continue
                    firm = k in sure and not any(r["missing"][b] for b in by)
                    best.append((not firm, i, sure.get(k, other.get(k)), ("" if firm else "~") + ",".join(by)))
                _, _, r[field], r["by"][field] = min(best, default=(0, 0, None, None))
    return rows


def _reports(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(1, n):
        place = rng.randint(0, 11)
        wrong = rng.randint(0, 11) if rng.random() < 0.25 else place
        rows.append([i, f"H{rng.randint(0, 40) if rng.random() < 0.5 else place}", f"{123400 + wrong}", f"Town {'abcdef'[place // 2]}", "XYZ"[wrong % 3], f"m{place % 3}", str(rng.randint(1, 99)) if rng.random() < 0.9 else None])
        for at, gone in ((2, "000000"), (3, "n/a"), (4, None), (1, None)):
            if rng.random() < 0.2:
                rows[-1][at] = gone
    return rows


def test_chains_by_brute_force(spark, scratch):
    rows = _reports(1200, 9)
    df = spark.createDataFrame(rows, "row_id bigint, hname string, zip string, city string, state string, measure string, score string")
    sets = [("city", [("zip",), ("hname",)]), ("zip", [("city", "state"), ("hname",)]), ("state", [("city",), ("zip",)])]
    plain = [{"id": r[0], "hname": r[1], "zip": None if r[2] == "000000" else r[2], "city": None if r[3] == "n/a" else r[3], "state": r[4]} for r in rows]
    for r in plain:
        r["missing"] = {f: r[f] is None for f in ("hname", "zip", "city", "state")}
    got = {r.row_id: r for r in chained_imputation(df, "row_id", [Category(f, tuple(s)) for f, s in sets], {"city": real_name(F.col("city")), "zip": real_code(F.col("zip"))}, scratch, 3).collect()}
    for r in _chain(plain, sets, 3):
        g = got[r["id"]]
        assert (g.city, g.zip, g.state, g.city_by, g.zip_by, g.state_by) == (r["city"], r["zip"], r["state"], *(r["by"].get(f) for f in ("city", "zip", "state")))


def test_table_of_filled_reports(spark, tmp_path):
    from depguard.queries.cleaning import QUERIES, SQL
    from tests.oracle import duckdb

    rows = _reports(1500, 7)
    spark.createDataFrame(rows, "row_id bigint, hname string, zip string, city string, state string, measure string, score string").write.parquet(f"{tmp_path}/hospital.parquet")
    table = QUERIES["p6_table"](spark, str(tmp_path)).collect()
    got = {r.row_id: r for r in table}
    assert len(table) == len(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW hospital AS SELECT * FROM '{tmp_path}/hospital.parquet/*.parquet'")
    wanted = con.execute(SQL["p6_found"]).fetchall()
    assert len(wanted) > 200 and all(got[i][field] == v and got[i][f"{field}_filled"] for i, field, v in wanted)
    assert sorted((r.row_id, f, r[f]) for r in table for f, by in (("city", "zip"), ("zip", "city,state")) if r[f"{f}_by"] == by) == sorted(wanted)
    assert all(r.score is not None and r.score_filled == (rows[r.row_id - 1][6] is None) for r in table)
    # What is drawn is as varied as what is observed: shares of the state among the filled and the others of a city.
    for city in {r.city for r in table if r.city and r.city_by is None}:
        seen = [r.state for r in table if r.city == city and not r.city_filled and not r.state_filled]
        drawn = [r.state for r in table if r.city == city and not r.city_filled and r.state_by == "city"]
        assert all(abs(seen.count(x) / len(seen) - drawn.count(x) / len(drawn)) < 0.3 for x in "XYZ") and len(set(drawn)) > 1


def test_held_out_values(spark, scratch):
    """Blanked values come back: cities and zips by their counterpart, numbers with the spread they had."""
    rng = random.Random(3)
    rows = [(i, f"{100 + (p := rng.randint(0, 19))}", f"c{p}", float(rng.gauss(10 * p, 3)), rng.random()) for i in range(1, 3000)]
    df = spark.createDataFrame([(i, z if u > 0.1 else None, c if not 0.1 < u < 0.2 else None, v if u < 0.8 else None) for i, z, c, v, u in rows], "id int, zip string, city string, v double")
    out = {r.id: r for r in chained_imputation(df, "id", [Category("city", ("zip",)), Category("zip", ("city",)), Number("v", ("city",))], {}, scratch).collect()}
    assert all(out[i].city == c and out[i].zip == z for i, z, c, _, _ in rows)
    left = [out[i].v - 10 * int(c[1:]) for i, _, c, _, u in rows if u >= 0.8]
    assert len(left) > 400 and abs(sum(left) / len(left)) < 0.6 and 2 < (sum(x * x for x in left) / len(left)) ** 0.5 < 4.5
