"""Queries for the rule operators, over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from depguard.api import detect
from depguard.functions.text import word_count
from depguard.operators import dc, dd, fd, pod
from depguard.operators.repair import CHANGED, VISITED, class_audit, equivalence_classes, repair, value_classes, vote
from depguard.rules import parse_rule
from depguard.session import Scratch, scratch_root
from depguard.sources import read_csv_ints, read_lines, read_text_with_header, write_repaired, write_report

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


O_FD, P_FD = "o_custkey->o_orderstatus", "p_brand,p_type->p_size"
_BAD = "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1"


@query("fd_rows", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN ({_BAD})")
def fd_rows(s, d):
    return fd.rows(t(s, d, "orders"), parse_rule(O_FD, "fd")).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("fd_report", f"SELECT (SELECT count(*) FROM orders WHERE o_custkey IN ({_BAD})) AS dirty, (SELECT count(*) FROM orders) AS total, '{O_FD}' AS rule")
def fd_report(s, d):
    return fd.fd_report(t(s, d, "orders"), parse_rule(O_FD, "fd"))


@query("fd_groups_top10", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 ORDER BY 1 LIMIT 10")
def fd_groups_top10(s, d):
    return fd.groups(t(s, d, "orders"), parse_rule(O_FD, "fd")).orderBy("o_custkey").limit(10)


@query("fd_groups", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def fd_groups(s, d):
    return fd.groups(t(s, d, "orders"), parse_rule(O_FD, "fd"))


@query("fd_rows_with_report", f"SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT count(*) FROM orders WHERE o_custkey IN ({_BAD})) AS dirty, (SELECT count(*) FROM orders) AS total, '{O_FD}' AS rule FROM orders WHERE o_custkey IN ({_BAD})")
def fd_rows_with_report(s, d):
    return fd.rows_with_report(t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), parse_rule(O_FD, "fd"))


@query("fd_clean", "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1)) AS dirty, count(*) AS total, 'c_custkey->c_nationkey' AS rule FROM customer")
def fd_clean(s, d):
    return fd.fd_report(t(s, d, "customer"), parse_rule("c_custkey->c_nationkey", "fd"))


@query("fd_nulls", """WITH c AS (SELECT zip, city, count(*) n FROM addr WHERE zip IS NOT NULL GROUP BY 1, 2), g AS (SELECT zip, sum(n) n FROM c GROUP BY 1 HAVING count(*) > 1)
SELECT (SELECT coalesce(sum(n), 0) FROM g)::BIGINT AS dirty, (SELECT count(*) FROM addr) AS total, 'zip->city' AS rule""")
def fd_nulls(s, d):
    return fd.fd_report(t(s, d, "addr"), parse_rule("zip_city", "fd"))


@query("rollup_counts", "SELECT o_custkey, o_orderstatus, count(*) AS count, grouping_id(o_custkey, o_orderstatus)::INT AS gid FROM orders GROUP BY ROLLUP (o_custkey, o_orderstatus)")
def rollup_counts(s, d):
    return fd.rollup_counts(t(s, d, "orders"), "o_custkey", "o_orderstatus")


_MFD = """WITH c AS (SELECT {l}, {r}, count(*)::HUGEINT n FROM {t} WHERE {ok} GROUP BY ALL), g AS (SELECT {l}, sum(n) n, sum(n * n) q FROM c GROUP BY {l})
SELECT (coalesce(sum(n * n - q), 0) // 2)::BIGINT AS dirty, (SELECT (count(*)::HUGEINT * (count(*) - 1) // 2)::BIGINT FROM {t}) AS total, '{l}@{r}' AS rule FROM g"""


@query("mfd_report", _MFD.format(l="l_suppkey", r="l_linestatus", t="lineitem", ok="true"))
def mfd_report(s, d):
    return fd.mfd_report(t(s, d, "lineitem"), parse_rule("l_suppkey@l_linestatus", "mfd"))


@query("mfd_report_multi", _MFD.format(l="p_brand,p_type", r="p_size", t="part", ok="true"))
def mfd_report_multi(s, d):
    return fd.mfd_report(t(s, d, "part"), parse_rule("p_brand,p_type@p_size", "mfd"))


@query("mfd_report_nulls", _MFD.format(l="zip,state", r="city", t="addr", ok="zip IS NOT NULL AND state IS NOT NULL AND city IS NOT NULL"))
def mfd_report_nulls(s, d):
    return fd.mfd_report(t(s, d, "addr"), parse_rule("zip,state@city", "mfd"))


@query("mfd_pair_rows", "SELECT a.p_partkey AS A_p_partkey, a.p_brand AS A_p_brand, a.p_type AS A_p_type, a.p_size AS A_p_size, b.p_partkey AS B_p_partkey, b.p_brand AS B_p_brand, b.p_type AS B_p_type, b.p_size AS B_p_size FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size <> b.p_size AND a.p_partkey < b.p_partkey")
def mfd_pair_rows(s, d):
    return fd.mfd_pairs(t(s, d, "part"), parse_rule("p_brand,p_type@p_size", "mfd"), "p_partkey")


@query("mfd_pair_rows_hot", "SELECT a.doc_id AS A_doc_id, a.source AS A_source, a.lang AS A_lang, b.doc_id AS B_doc_id, b.source AS B_source, b.lang AS B_lang FROM documents a JOIN documents b ON a.source = b.source AND a.lang <> b.lang AND a.doc_id < b.doc_id")
def mfd_pair_rows_hot(s, d):
    """The survey's table, in which one source holds a tenth of the rows."""
    return fd.mfd_pairs(t(s, d, "documents"), parse_rule("source@lang", "mfd"), "doc_id")


def _vote_sql(table: str, lhs: str, rhs: str, majority: bool = False) -> str:
    on = " AND ".join(f"{c} IS NOT NULL" for c in lhs.split(","))
    more = f" AND {rhs} IS NOT NULL AND 2 * n > tot" if majority else f" AND {rhs} IS NOT NULL"
    return f"""SELECT {lhs}, {rhs} AS winner FROM (SELECT *, row_number() OVER (PARTITION BY {lhs} ORDER BY {rhs} IS NULL, n DESC, {rhs}) k, count(*) OVER (PARTITION BY {lhs}) dv, sum(n) OVER (PARTITION BY {lhs}) tot
FROM (SELECT {lhs}, {rhs}, count(*) n FROM {table} WHERE {on} GROUP BY ALL)) WHERE k = 1 AND dv > 1{more}"""


@query("vote_majority", _vote_sql("orders", "o_custkey", "o_orderstatus", True))
def vote_majority(s, d):
    return vote(t(s, d, "orders"), ("o_custkey",), "o_orderstatus", "majority")


@query("vote_majority_unanimous", _vote_sql("orders", "o_custkey", "o_orderstatus", True).replace("dv > 1", "dv > 0"))
def vote_majority_unanimous(s, d):
    return vote(t(s, d, "orders"), ("o_custkey",), "o_orderstatus", "majority", unanimous=True)


@query("vote_plurality", _vote_sql("addr", "zip", "city"))
def vote_plurality(s, d):
    return vote(t(s, d, "addr"), ("zip",), "city")


def _repair_sql(table: str, key: str, lhs: str, rhs: str, majority: bool = False) -> str:
    on = " AND ".join(f"f.{c} = t.{c}" for c in lhs.split(","))
    return f"SELECT t.{key}, {', '.join('t.' + c for c in lhs.split(','))}, coalesce(f.winner, t.{rhs}) AS {rhs}, f.winner IS NOT NULL AS _visited, f.winner IS NOT NULL AND f.winner IS DISTINCT FROM t.{rhs} AS _changed FROM {table} t LEFT JOIN ({_vote_sql(table, lhs, rhs, majority)}) f ON {on}"


@query("repair_majority", _repair_sql("orders", "o_orderkey", "o_custkey", "o_orderstatus", True))
def repair_majority(s, d):
    return repair(t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), parse_rule(O_FD, "fd"), kind="majority", flags=True).df


@query("repair_plurality", _repair_sql("addr", "id", "zip", "city"))
def repair_plurality(s, d):
    return repair(t(s, d, "addr").select("id", "zip", "city"), parse_rule("zip->city", "fd"), flags=True).df


@query("repair_composite", _repair_sql("part", "p_partkey", "p_brand,p_type", "p_size"))
def repair_composite(s, d):
    return repair(t(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), parse_rule(P_FD, "fd"), flags=True).df


_REP = _repair_sql("addr", "id", "zip", "city")


@query("repair_report_visited", f"SELECT count(*) FILTER (_visited) AS dirty, count(*) AS total, 'zip->city' AS rule FROM ({_REP})")
def repair_report_visited(s, d):
    return repair(t(s, d, "addr").select("id", "zip", "city"), parse_rule("zip->city", "fd")).report(VISITED)


@query("repair_report_changed", f"SELECT count(*) FILTER (_changed) AS dirty, count(*) AS total, 'zip->city' AS rule FROM ({_REP})")
def repair_report_changed(s, d):
    return repair(t(s, d, "addr").select("id", "zip", "city"), parse_rule("zip->city", "fd")).report(CHANGED)


@query("repair_redetect", f"""WITH r AS ({_REP}), q AS (SELECT zip, city, count(*) n FROM addr WHERE zip IS NOT NULL GROUP BY ALL), q2 AS (SELECT zip, city, count(*) n FROM r WHERE zip IS NOT NULL GROUP BY ALL)
SELECT (SELECT coalesce(sum(n), 0) FROM (SELECT zip, sum(n) n FROM q GROUP BY 1 HAVING count(*) > 1))::BIGINT AS dirty_before, (SELECT coalesce(sum(n), 0) FROM (SELECT zip, sum(n) n FROM q2 GROUP BY 1 HAVING count(*) > 1))::BIGINT AS dirty_after, (SELECT count(*) FROM addr) AS total, 'zip->city' AS rule""")
def repair_redetect(s, d):
    df, rule = t(s, d, "addr").select("id", "zip", "city"), parse_rule("zip->city", "fd")
    return fd.before_after(df, repair(df, rule).df, rule)


def _chain_sql(majority: bool) -> str:
    first = _repair_sql("orders", "o_orderkey", "o_custkey", "o_orderstatus", majority).replace(" AS _changed", " AS _changed, t.o_orderpriority")
    return f"""WITH a AS MATERIALIZED ({first}), f AS ({_vote_sql('a', 'o_orderstatus', 'o_orderpriority', majority)})
SELECT a.o_orderkey, a.o_custkey, a.o_orderstatus, coalesce(f.winner, a.o_orderpriority) AS o_orderpriority, a._visited OR f.winner IS NOT NULL AS _visited, a._changed OR (f.winner IS NOT NULL AND f.winner IS DISTINCT FROM a.o_orderpriority) AS _changed
FROM a LEFT JOIN f ON f.o_orderstatus = a.o_orderstatus"""


def _chain(s, d, kind):
    df = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return repair(df, parse_rule("o_custkey->o_orderstatus;o_orderstatus->o_orderpriority", "fdset"), kind=kind, flags=True).df


@query("repair_fd_list", _chain_sql(True))
def repair_fd_list(s, d):
    return _chain(s, d, "majority")


@query("repair_fd_list_plurality", _chain_sql(False))
def repair_fd_list_plurality(s, d):
    return _chain(s, d, "plurality")


@query("repair_multi", f"""WITH a AS MATERIALIZED ({_repair_sql("part", "p_partkey", "p_brand", "p_type").replace(" AS _changed", " AS _changed, t.p_size")}), f AS ({_vote_sql("a", "p_brand,p_type", "p_size")})
SELECT a.p_partkey, a.p_brand, a.p_type, coalesce(f.winner, a.p_size) AS p_size, a._visited OR f.winner IS NOT NULL AS _visited, a._changed OR (f.winner IS NOT NULL AND f.winner IS DISTINCT FROM a.p_size) AS _changed FROM a LEFT JOIN f ON f.p_brand = a.p_brand AND f.p_type = a.p_type""")
def repair_multi(s, d):
    df = t(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return repair(df, parse_rule("p_brand->p_type;p_brand,p_type->p_size", "fdset"), flags=True).df


@query("repair_cycle", "SELECT unnest(['o_orderpriority', 'o_orderstatus']) AS unrepaired, (SELECT count(*) FROM orders) AS total")
def repair_cycle(s, d):
    df = t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    done = repair(df, parse_rule("o_orderstatus->o_orderpriority;o_orderpriority->o_orderstatus", "fdset"))
    names = F.explode(F.array(*map(F.lit, sorted(done.unrepaired)))).alias("unrepaired")
    return done.report().select(names, "total")


def _classes_sql(table: str, key: str, cols: str, *values: str) -> str:
    """CTEs ending in cls(key.., cols.., c): rows that share a value of any kind are in one class, named by its smallest
    key, as SQL. Labels spread along (smaller label only) until they no longer change."""
    kinds = " UNION ALL ".join(f"SELECT {key} AS k, '{i}' || ({v}) AS x FROM {table} WHERE ({v}) IS NOT NULL" for i, v in enumerate(values))
    return f"""WITH RECURSIVE v AS ({kinds}), m AS (SELECT x, min(k) AS k FROM v GROUP BY 1),
e AS (SELECT DISTINCT a.k AS p, b.k AS q FROM v x JOIN v y USING (k) JOIN m a ON a.x = x.x JOIN m b ON b.x = y.x WHERE a.k <> b.k),
r(p, q) AS (SELECT DISTINCT k, k FROM m UNION SELECT e.q, r.q FROM r JOIN e ON e.p = r.p AND r.q < e.q), l AS (SELECT p, min(q) AS g FROM r GROUP BY 1),
f AS (SELECT v.k, min(l.g) AS c FROM v JOIN m USING (x) JOIN l ON l.p = m.k GROUP BY 1), cls AS (SELECT t.{key}, {cols}, f.c FROM {table} t LEFT JOIN f ON f.k = t.{key})"""


_EQ = _classes_sql("equivalence", "rec_id", "zip, city, state", "zip", "city")
#: Classes by their smallest zip; records without one have the zip of their class, if any record of it has one.
_NAMED = f"{_EQ}, named AS (SELECT c, min(zip) AS eqclass FROM cls GROUP BY 1), lab AS (SELECT cls.rec_id, cls.state, cls.c, named.eqclass FROM cls LEFT JOIN named USING (c))"


@query("eqclass", f"{_NAMED} SELECT rec_id, eqclass FROM lab")
def eqclass(s, d):
    """Records whose zips share cities, through any chain: the smallest zip names the class."""
    return value_classes(t(s, d, "equivalence").select("rec_id", "zip", "city"), "zip", "city", Scratch(s)).select("rec_id", "eqclass")


@query("eqclass_audit", f"{_NAMED}, g AS (SELECT eqclass, state, count(*) n FROM lab WHERE eqclass IS NOT NULL GROUP BY 1, 2) SELECT eqclass, count(*) AS n_values, sum(n)::BIGINT AS n_rows FROM g GROUP BY 1 HAVING count(*) > 1")
def eqclass_audit(s, d):
    """Classes whose records disagree on the state."""
    return class_audit(value_classes(t(s, d, "equivalence").select("zip", "city", "state"), "zip", "city", Scratch(s)), "state")


_FLAGS = "w.winner IS NOT NULL AS _visited, w.winner IS NOT NULL AND w.winner IS DISTINCT FROM {0} AS _changed FROM cls LEFT JOIN w ON w.c = cls.c"


@query("eqclass_repair", f"{_EQ}, w AS ({_vote_sql('cls', 'c', 'state')}) SELECT rec_id, zip, city, coalesce(w.winner, state) AS state, {_FLAGS.format('state')}")
def eqclass_repair(s, d):
    df = t(s, d, "equivalence").select("rec_id", "zip", "city", "state")
    return repair(df, parse_rule("zip->state;city->state", "fdset"), flags=True).df


@query("eqclass_three", f"{_classes_sql('addr', 'id', 'phone, zip, fname, salary, leve, state', 'phone', chr(39).join(['zip || ', '|', ' || fname']), chr(39).join(['salary::VARCHAR || ', '|', ' || leve || ', '|', ' || fname']))}, w AS ({_vote_sql('cls', 'c', 'state')}) SELECT id, coalesce(w.winner, state) AS state, {_FLAGS.format('state')}")
def eqclass_three(s, d):
    """Three left sides for one right side: records of a phone, of a zip and first name, or of a salary, level and first name."""
    df = t(s, d, "addr").select("id", "phone", "zip", "fname", "salary", "leve", "state")
    rules = parse_rule("phone->state;zip,fname->state;salary,leve,fname->state", "fdset")
    return repair(df, rules, flags=True).df.select("id", "state", VISITED, CHANGED)


@query("eqclass_composite", f"{_classes_sql('part', 'p_partkey', 'p_name, p_brand, p_retailprice, p_size', "p_name || '|' || p_brand", 'p_retailprice::VARCHAR')}, w AS ({_vote_sql('cls', 'c', 'p_size')}) SELECT p_partkey, p_name, p_brand, p_retailprice, coalesce(w.winner, p_size) AS p_size, w.winner IS NOT NULL AS _visited, w.winner IS NOT NULL AND w.winner IS DISTINCT FROM p_size AS _changed FROM cls LEFT JOIN w ON w.c = cls.c")
def eqclass_composite(s, d):
    df = t(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice", "p_size")
    return repair(df, parse_rule("p_name,p_brand->p_size;p_retailprice->p_size", "fdset"), flags=True).df


_ZS = "SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT zip, sum(n) n FROM (SELECT zip, state, count(*) n FROM {0} WHERE zip IS NOT NULL GROUP BY ALL) GROUP BY 1 HAVING count(*) > 1)"


@query("eqclass_two_rules", f"{_classes_sql('equivalence', 'rec_id', 'zip, state', 'zip', 'city')}, w AS ({_vote_sql('cls', 'c', 'state', True)}), o AS (SELECT cls.zip, coalesce(w.winner, cls.state) AS state FROM cls LEFT JOIN w ON w.c = cls.c) SELECT ({_ZS.format('equivalence')}) AS dirty_before, ({_ZS.format('o')}) AS dirty_after, (SELECT count(*) FROM equivalence) AS total, 'zip->state' AS rule")
def eqclass_two_rules(s, d):
    """Two rules for one right side: class by class majority, and the share of dirty rows before and after."""
    df = t(s, d, "equivalence").select("zip", "city", "state")
    done = repair(df, parse_rule("zip->state;city->state", "fdset"), kind="majority")
    rule = parse_rule("zip->state", "fd")
    return fd.before_after(df, done.df, rule)


_S2 = "A.s_nationkey=B.s_nationkey@A.s_acctbal>B.s_acctbal"
_S2_SQL = "FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal > b.s_acctbal AND a.s_suppkey <> b.s_suppkey"


@query("dc_pairs", f"SELECT a.s_suppkey AS A_s_suppkey, a.s_nationkey AS A_s_nationkey, a.s_acctbal AS A_s_acctbal, b.s_suppkey AS B_s_suppkey, b.s_nationkey AS B_s_nationkey, b.s_acctbal AS B_s_acctbal {_S2_SQL}")
def dc_pairs(s, d):
    return dc.pairs(t(s, d, "supplier"), parse_rule(_S2, "dc"), "s_suppkey")


@query("dc_report", f"SELECT (SELECT count(*) FROM (SELECT DISTINCT least(a.s_suppkey, b.s_suppkey), greatest(a.s_suppkey, b.s_suppkey) {_S2_SQL})) AS dirty, (SELECT (count(*) * (count(*) - 1) // 2)::BIGINT FROM supplier) AS total, (SELECT count(*) {_S2_SQL}) AS ordered_pairs, '{_S2}' AS rule")
def dc_report(s, d):
    return dc.dc_report(t(s, d, "supplier"), parse_rule(_S2, "dc"), "s_suppkey")


@query("dc_report_clamped", f"WITH o AS (SELECT count(*) AS o {_S2_SQL}), n AS (SELECT count(*) AS n FROM supplier) SELECT (CASE WHEN o < 0.01 * n * n THEN CASE WHEN o = 0 THEN 0 ELSE 2 END ELSE o END)::BIGINT AS dirty, (CASE WHEN o < 0.01 * n * n THEN 9900 ELSE n * (n - 1) END)::BIGINT AS total, o AS ordered_pairs, '{_S2}' AS rule FROM o, n")
def dc_report_clamped(s, d):
    return dc.dc_report(t(s, d, "supplier"), parse_rule(_S2, "dc"), "s_suppkey", clamp=True)


@query("dc_order", "SELECT a.o_orderkey AS A_o_orderkey, b.o_orderkey AS B_o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_totalprice > b.o_totalprice AND a.o_orderdate < b.o_orderdate")
def dc_order(s, d):
    rule = parse_rule("A.o_custkey=B.o_custkey@A.o_totalprice>B.o_totalprice@A.o_orderdate<B.o_orderdate", "dc")
    return dc.pairs(t(s, d, "orders"), rule, "o_orderkey").select("A_o_orderkey", "B_o_orderkey")


@query("dc_single", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
def dc_single(s, d):
    return dc.rows(t(s, d, "lineitem"), parse_rule("A.l_quantity>45@A.l_discount<0.02", "dc")).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("dc_mixed", f"SELECT a.s_suppkey AS A_s_suppkey, b.s_suppkey AS B_s_suppkey {_S2_SQL} AND a.s_acctbal > 5000")
def dc_mixed(s, d):
    return dc.pairs(t(s, d, "supplier"), parse_rule(_S2 + "@A.s_acctbal>5000", "dc"), "s_suppkey").select("A_s_suppkey", "B_s_suppkey")


@query("dc_mixed_both", f"SELECT a.s_suppkey AS A_s_suppkey, b.s_suppkey AS B_s_suppkey {_S2_SQL} AND a.s_acctbal > 5000 AND b.s_acctbal > 5000")
def dc_mixed_both(s, d):
    return dc.pairs(t(s, d, "supplier"), parse_rule(_S2 + "@A.s_acctbal>5000", "dc"), "s_suppkey", both_sides=True).select("A_s_suppkey", "B_s_suppkey")


@query("dc_no_equality", "SELECT a.s_suppkey AS A_s_suppkey, b.s_suppkey AS B_s_suppkey FROM supplier a JOIN supplier b ON a.s_acctbal > b.s_acctbal AND a.s_nationkey < b.s_nationkey")
def dc_no_equality(s, d):
    return dc.pairs(t(s, d, "supplier"), parse_rule("A.s_acctbal>B.s_acctbal@A.s_nationkey<B.s_nationkey", "dc"), "s_suppkey").select("A_s_suppkey", "B_s_suppkey")


_OD = "A.o_totalprice>B.o_totalprice@A.o_orderdate<B.o_orderdate"


@query("dc_report_order", f"SELECT count(*) AS dirty, (SELECT (count(*)::HUGEINT * (count(*) - 1) // 2)::BIGINT FROM orders) AS total, count(*) AS ordered_pairs, '{_OD}' AS rule FROM orders a JOIN orders b ON a.o_totalprice > b.o_totalprice AND a.o_orderdate < b.o_orderdate")
def dc_report_order(s, d):
    """Only comparisons of order, over a whole table: pairs are counted, not formed."""
    return dc.dc_report(t(s, d, "orders"), parse_rule(_OD, "dc"))


@query("dc_rows", f"SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey IN (SELECT a.s_suppkey {_S2_SQL} UNION SELECT b.s_suppkey {_S2_SQL})")
def dc_rows(s, d):
    """The rows that take part in any violating pair."""
    return detect(t(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), parse_rule(_S2, "dc"), "s_suppkey", "rows")


@query("dc_text_numbers", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 9 AND s_nationkey < 20")
def dc_text_numbers(s, d):
    """Columns of a text source compared as numbers."""
    text = t(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("string"), F.col("s_nationkey").cast("string"))
    return dc.rows(text, parse_rule("A.s_acctbal>9@20>A.s_nationkey", "dc"), frozenset({"s_acctbal", "s_nationkey"})).select("s_suppkey")


_DD, _DD_SQL = "c_acctbal<50@c_nationkey<10", "FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) < 50 AND abs(a.c_nationkey - b.c_nationkey) >= 10"


@query("dd_pairs", f"SELECT a.c_custkey AS A_c_custkey, b.c_custkey AS B_c_custkey {_DD_SQL}")
def dd_pairs(s, d):
    return dd.dd_pairs(t(s, d, "customer"), parse_rule(_DD, "dd"), "c_custkey").select("A_c_custkey", "B_c_custkey")


@query("dd_report", f"SELECT (SELECT count(*) {_DD_SQL}) AS dirty, (SELECT (count(*) * (count(*) - 1) // 2)::BIGINT FROM customer) AS total, '{_DD}' AS rule")
def dd_report(s, d):
    return dd.dd_report(t(s, d, "customer"), parse_rule(_DD, "dd"), "c_custkey")


_LC = "WITH c AS (SELECT {0}, count(*)::HUGEINT AS n FROM lineitem GROUP BY ALL)"
_LDC = "A.l_returnflag=B.l_returnflag@A.l_quantity>B.l_quantity@A.l_discount<B.l_discount"


@query("dc_report_large", f"{_LC.format('l_returnflag, l_quantity, l_discount')} SELECT sum(a.n * b.n)::BIGINT AS dirty, (SELECT (count(*)::HUGEINT * (count(*) - 1) // 2)::BIGINT FROM lineitem) AS total, sum(a.n * b.n)::BIGINT AS ordered_pairs, '{_LDC}' AS rule FROM c a JOIN c b ON a.l_returnflag = b.l_returnflag AND a.l_quantity > b.l_quantity AND a.l_discount < b.l_discount")
def dc_report_large(s, d):
    """A table without a key: classes of equal rows are compared, not rows."""
    return dc.dc_report(t(s, d, "lineitem"), parse_rule(_LDC, "dc"))


@query("dd_report_large", f"{_LC.format('l_quantity, l_tax')} SELECT (coalesce(sum(CASE WHEN a.l_quantity = b.l_quantity AND a.l_tax = b.l_tax THEN 0 ELSE a.n * b.n END), 0) // 2)::BIGINT AS dirty, (SELECT (count(*)::HUGEINT * (count(*) - 1) // 2)::BIGINT FROM lineitem) AS total, 'l_quantity<=2@l_tax<0.035' AS rule FROM c a JOIN c b ON abs(a.l_quantity - b.l_quantity) <= 2 AND abs(a.l_tax - b.l_tax) >= 0.035")
def dd_report_large(s, d):
    return dd.dd_report(t(s, d, "lineitem"), parse_rule("l_quantity<=2@l_tax<0.035", "dd"))


@query("dd_grid", "SELECT a.s_suppkey AS A_s_suppkey, b.s_suppkey AS B_s_suppkey FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 500 AND abs(a.s_nationkey - b.s_nationkey) >= 5")
def dd_grid(s, d):
    return dd.dd_pairs(t(s, d, "supplier"), parse_rule("s_acctbal<500@s_nationkey<5", "dd"), "s_suppkey", strategy="grid").select("A_s_suppkey", "B_s_suppkey")


@query("dd_far", "SELECT a.c_custkey AS A_c_custkey, b.c_custkey AS B_c_custkey FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) > 9000 AND abs(a.c_nationkey - b.c_nationkey) >= 10")
def dd_far(s, d):
    """A left distance without an upper bound: pairs meet in the cells of a grid whose ranges can be that far apart."""
    return dd.dd_pairs(t(s, d, "customer"), parse_rule("c_acctbal>9000@c_nationkey<10", "dd"), "c_custkey").select("A_c_custkey", "B_c_custkey")


_POD = "(t.{0} > s.{0} AND t.{1} > s.{1} AND t.{2} <= s.{2})"


@query("pod_incremental", "SELECT t.c_custkey AS add_id, s.c_custkey AS base_id, CASE WHEN t.c_nationkey > s.c_nationkey THEN 1 ELSE -1 END AS direction FROM customer t JOIN customer s ON t.c_custkey % 10 = 0 AND s.c_custkey % 10 <> 0 AND ((t.c_nationkey > s.c_nationkey AND t.c_custkey > s.c_custkey AND t.c_acctbal <= s.c_acctbal) OR (t.c_nationkey < s.c_nationkey AND t.c_custkey < s.c_custkey AND t.c_acctbal >= s.c_acctbal))")
def pod_incremental(s, d):
    """The batch is every tenth customer, the base the others: that split is the input of the operator."""
    c = t(s, d, "customer")
    rule = parse_rule("[c_nationkey>][c_custkey>]->[c_acctbal>]", "pod")
    return pod.pod_incremental(c.filter("c_custkey % 10 <> 0"), c.filter("c_custkey % 10 = 0"), rule, "c_custkey")


@query("pod_tax", "SELECT t.id AS add_id, s.id AS base_id, CASE WHEN t.a1 > s.a1 THEN 1 ELSE -1 END AS direction FROM tax_add t JOIN tax_base s ON (t.a1 > s.a1 AND t.a2 > s.a2 AND t.c <= s.c) OR (t.a1 < s.a1 AND t.a2 < s.a2 AND t.c >= s.c)")
def pod_tax(s, d):
    return pod.pod_incremental(t(s, d, "tax_base"), t(s, d, "tax_add"), parse_rule("[a1>][a2>]->[c>]", "pod"), "id")


@query("pod_within_add", "WITH s AS (SELECT * FROM tax_base UNION ALL SELECT * FROM tax_add) SELECT t.id AS add_id, s.id AS base_id, CASE WHEN t.a1 > s.a1 THEN 1 ELSE -1 END AS direction FROM tax_add t JOIN s ON t.id <> s.id AND ((t.a1 > s.a1 AND t.a2 > s.a2 AND t.c <= s.c) OR (t.a1 < s.a1 AND t.a2 < s.a2 AND t.c >= s.c))")
def pod_within_add(s, d):
    """The batch against the base and against itself."""
    return pod.pod_incremental(t(s, d, "tax_base"), t(s, d, "tax_add"), parse_rule("[a1>][a2>]->[c>]", "pod"), "id", within_add=True)


@query("pod_self", "SELECT t.id AS add_id, s.id AS base_id, CASE WHEN t.a1 > s.a1 THEN 1 ELSE -1 END AS direction FROM tax_add t JOIN tax_add s ON t.id <> s.id AND ((t.a1 > s.a1 AND t.a2 > s.a2 AND t.c <= s.c) OR (t.a1 < s.a1 AND t.a2 < s.a2 AND t.c >= s.c))")
def pod_self(s, d):
    """A table against itself."""
    return detect(t(s, d, "tax_add"), parse_rule("[a1>][a2>]->[c>]", "pod"), "id", "pairs")


@query("pod_representatives", "SELECT id, min(id) OVER (PARTITION BY a1, a2, c) AS rep FROM tax_base")
def pod_representatives(s, d):
    return pod.representatives(t(s, d, "tax_base"), ["a1", "a2", "c"], "id")


@query("pod_compress", "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS rep, count(*) AS n FROM customer GROUP BY 1, 2")
def pod_compress(s, d):
    return pod.compress(t(s, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("wordcount", "SELECT word, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1")
def wordcount(s, d):
    return word_count(t(s, d, "documents"), "text")


@query("wordcount_lines", "SELECT word, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def wordcount_lines(s, d):
    """The same on a source of text lines."""
    path = f"{Scratch(s).root}/part-lines"
    t(s, d, "part").select(F.col("p_name").alias("value")).write.text(path)
    return word_count(read_lines(s, path), "value")


@query("text_source_roundtrip", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def text_source_roundtrip(s, d):
    path = f"{Scratch(s).root}/nation-text"
    n = t(s, d, "nation").select(*(F.col(c).cast("string") for c in ("n_nationkey", "n_name", "n_regionkey")))
    n.select(F.concat_ws(",", *n.columns).alias("value")).write.mode("overwrite").text(path)
    return read_text_with_header(s, path, " n_nationkey , n_name,n_regionkey")


@query("csv_source_roundtrip", "SELECT id, a1, a2, c FROM tax_add")
def csv_source_roundtrip(s, d):
    path = f"{Scratch(s).root}/tax-csv"
    t(s, d, "tax_add").select("id", "a1", "a2", "c").write.csv(path)
    return read_csv_ints(s, path, ["id", "a1", "a2", "c"])


@query("report_sink", SQL["fd_report"])
def report_sink(s, d):
    return s.read.parquet(write_report(fd_report(s, d), f"{Scratch(s).root}/report"))


@query("repaired_sink", f"SELECT id, zip, city FROM ({_REP})")
def repaired_sink(s, d):
    done = repair(t(s, d, "addr").select("id", "zip", "city"), parse_rule("zip->city", "fd"), flags=True)
    return s.read.parquet(write_repaired(done.df, f"{Scratch(s).root}/repaired"))
