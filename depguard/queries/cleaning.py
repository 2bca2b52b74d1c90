"""Queries for the cleaning operators, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from depguard.operators.heavy import per_key_report
from depguard.operators.impute import STAND_INS, Category, Number, chained_imputation, real_code, real_name
from depguard.operators.malformed import Field, LineSchema, check_lines, load_lines
from depguard.session import Scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


_KEYED = """SELECT '{k}' AS field, {k} AS key_value, n, CASE WHEN vote IS NULL THEN 0 ELSE n - best END AS dirty, vote FROM (
SELECT {k}, sum(n)::BIGINT AS n, first({d} ORDER BY {d} IS NULL, n DESC, {d}) AS vote, coalesce(max(n) FILTER ({d} IS NOT NULL), 0) AS best FROM (SELECT {k}, {d}, count(*) AS n FROM addr WHERE {k} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


def _per_key(s, d, extra=()):
    a, scratch = t(s, d, "addr"), Scratch(s)
    parts = [per_key_report(a, k, v, scratch).select(F.lit(k).alias("field"), "key_value", "n", "dirty", "vote", *extra) for k, v in (("zip", "city"), ("city", "state"))]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("p2_found", "SELECT 'zip' AS field, zip AS key_value FROM addr WHERE zip IS NOT NULL GROUP BY zip HAVING count(*) * 50 >= (SELECT count(*) FROM addr) UNION ALL SELECT 'city', city FROM addr WHERE city IS NOT NULL GROUP BY city HAVING count(*) * 50 >= (SELECT count(*) FROM addr)")
def p2_found(s, d):
    return _per_key(s, d, ("total",)).filter("n * 50 >= total").select("field", "key_value")


@query("p2_per_key", _KEYED.format(k="zip", d="city") + " UNION ALL " + _KEYED.format(k="city", d="state"))
def p2_per_key(s, d):
    return _per_key(s, d)


RDDDF = LineSchema([Field("zip"), Field("city", "name"), Field("state"), Field("phone"), Field("salary", "int"), Field("areacode")])
_F = r"""(?:[^",]*|"(?:[^"]|"")*")"""
_P4 = f"""(SELECT *, CASE WHEN line IS NULL THEN 'columns' WHEN NOT regexp_full_match(line, '{_F}(?:,{_F})*') THEN 'quoting' WHEN NOT regexp_full_match(line, '{_F}(?:,{_F}){{5}}') THEN 'columns'
WHEN NOT regexp_matches(city, '\\p{{L}}') OR contains(city, chr(65533)) THEN 'value' WHEN salary <> '' AND (NOT regexp_full_match(salary, '-?[0-9]+') OR try_cast(salary AS INTEGER) IS NULL) THEN 'value' END AS reason
FROM (SELECT *, regexp_extract(line, '^{_F},({_F})(?:,|$)', 1) AS city, trim(CASE WHEN raw LIKE '"%"' THEN raw[2:-2] ELSE raw END, ' ' || chr(9)) AS salary FROM (SELECT *, regexp_extract(line, '^(?:{_F},){{4}}({_F})(?:,|$)', 1) AS raw FROM rdddf_raw)))"""


@query("p4_found", f"SELECT line_no, reason FROM {_P4} WHERE reason IS NOT NULL")
def p4_found(s, d):
    return check_lines(t(s, d, "rdddf_raw"), "line", RDDDF).filter("reason is not null").select("line_no", "reason")


@query("p4_rows", f"""SELECT line_no, feed, epoch_us(loaded_at) AS loaded_us, {', '.join(f"replace(CASE WHEN f{i} LIKE '\"%\"' THEN f{i}[2:-2] ELSE f{i} END, '\"\"', '\"') AS {n}" for i, n in enumerate(['zip', 'city', 'state', 'phone'], 1))}, try_cast(nullif(salary, '') AS INTEGER) AS salary, replace(CASE WHEN f6 LIKE '"%"' THEN f6[2:-2] ELSE f6 END, '""', '"') AS areacode
FROM (SELECT line_no, feed, loaded_at, salary, {', '.join(f"regexp_extract(line, '^(?:{_F},){{{i - 1}}}({_F})(?:,|$)', 1) AS f{i}" for i in (1, 2, 3, 4, 6))} FROM {_P4} WHERE reason IS NULL)""")
def p4_rows(s, d):
    """The table RddDF with what came along with each line; times in microseconds since 1970."""
    good = load_lines(t(s, d, "rdddf_raw"), "line", RDDDF)[0]
    return good.withColumn("loaded_at", F.unix_micros("loaded_at")).withColumnRenamed("loaded_at", "loaded_us")


_SHAPES = " + ".join(f"regexp_matches(line, '^{_F}(?:,{_F}){{{i}}}(?:,|$)')::INT" for i in range(6))


@query("p4_rejected", f"""SELECT line_no, line, feed, epoch_us(loaded_at) AS loaded_us, reason, CASE WHEN line IS NULL THEN 1 WHEN reason <> 'value' THEN 1 + {_SHAPES} WHEN NOT regexp_matches(city, '\\p{{L}}') OR contains(city, chr(65533)) THEN 2 ELSE 5 END AS broken_field FROM {_P4} WHERE reason IS NOT NULL""")
def p4_rejected(s, d):
    """The other lines, whole, each with its reason and the number of the field where it was found."""
    bad = load_lines(t(s, d, "rdddf_raw"), "line", RDDDF)[1]
    return bad.withColumn("loaded_at", F.unix_micros("loaded_at")).withColumnRenamed("loaded_at", "loaded_us")


_WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in STAND_INS)
_HOSPITAL = f"""WITH b AS (SELECT *, lower(regexp_replace(regexp_replace(city, '^[^\\p{{L}}\\p{{N}}#]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '')) AS bare FROM hospital),
m AS MATERIALIZED (SELECT row_id, zip, city, state, coalesce(regexp_matches(bare, '\\p{{L}}') AND NOT (length(bare) > 1 AND regexp_matches(bare, '^\\p{{L}}+$') AND replace(bare, bare[1], '') = '') AND bare NOT IN ({_WORDS}), false) AS rc,
coalesce(regexp_full_match(zip, '[0-9]{{6}}') AND replace(zip, zip[1], '') <> '', false) AS rz FROM b)"""
_FILLS = """SELECT row_id, 'city' AS field, fill_value FROM m JOIN (SELECT zip, first(city ORDER BY n DESC, city) AS fill_value FROM (SELECT zip, city, count(*) n FROM m WHERE rz AND rc GROUP BY ALL) GROUP BY 1) USING (zip) WHERE rz AND NOT rc
UNION ALL SELECT row_id, 'zip', fill_value FROM m JOIN (SELECT city, state, first(zip ORDER BY n DESC, zip) AS fill_value FROM (SELECT city, state, zip, count(*) n FROM m WHERE rz AND rc AND state IS NOT NULL GROUP BY ALL) GROUP BY 1, 2) USING (city, state) WHERE rc AND NOT rz"""


def _hospital(s, d, score):
    """City, zip, state and, if asked for, score of the reports by one chained run (no other field depends on the score). City and zip follow what zip, or city and state, say;
    where those don't decide they are drawn from what the hospital's other reports have. The state is drawn from the
    city's; scores come from a regression with its residual variation."""
    h = t(s, d, "hospital").withColumn("score", F.col("score").try_cast("double"))
    real = {"city": real_name(F.col("city")), "zip": real_code(F.col("zip"))}
    eqs = [Category("city", (("zip",), ("hname",)), draw=(1,)), Category("zip", (("city", "state"), ("hname",)), draw=(1,)), Category("state", (("city",), ("zip",)), draw=True), Number("score", ("measure", "state"))]
    return chained_imputation(h, "row_id", eqs if score else eqs[:3], real, Scratch(s), rounds=2)


@query("p6_found", f"{_HOSPITAL} {_FILLS}")
def p6_found(s, d):
    """Of the chained run, the cities and zips that observed values of zip, or of city and state, decided."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.when(F.col(f"{f}_by") == by, F.col(f)).alias("fill_value")) for f, by in (("city", "zip"), ("zip", "city,state"))))
    return _hospital(s, d, False).filter("city_filled or zip_filled").select("row_id", F.inline(rows)).filter("fill_value is not null")


@query("p6_table")
def p6_table(s, d):
    """Every report with its gaps filled and marked, and by what each was filled."""
    return _hospital(s, d, True).drop("city_missing", "zip_missing", "state_missing", "score_missing")
