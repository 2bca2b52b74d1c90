"""Queries for the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from depguard.llm.canon import map_to_list
from depguard.llm.decompose import record_groups
from depguard.llm.formatdup import CopyRule, collapse, copies
from depguard.llm.leakage import leaks
from depguard.llm.packing import pack, token_sizes
from depguard.llm.residue import residue, without_residue
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


ADDR = CopyRule(exact=("zip", "state", "phone", "salary", "areacode", "leve"), loose=("fname", "city"), swappable=("fname", "city"))
_LOOSE = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+', '', 'g'))"
_P1 = f"""WITH n AS (SELECT *, {_LOOSE.format('fname')} AS nf, {_LOOSE.format('city')} AS nc FROM addr),
k AS (SELECT *, CASE WHEN nf IS NULL OR nc IS NULL THEN nf ELSE least(nf, nc) END AS x, CASE WHEN nf IS NULL OR nc IS NULL THEN nc ELSE greatest(nf, nc) END AS y FROM n),
g AS (SELECT *, min(id) OVER w AS rep_id, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY zip, state, phone, salary, areacode, leve, x, y))"""


@query("p1_found", f"{_P1} SELECT rep_id::BIGINT AS rep_id, id::BIGINT AS id FROM g WHERE id > rep_id")
def p1_found(s, d):
    return copies(t(s, d, "addr"), "id", ADDR, Scratch(s)).filter("id > rep_id").select(F.col("rep_id").cast("bigint"), F.col("id").cast("bigint"))


@query("p1_collapsed", f"{_P1} SELECT * EXCLUDE (nf, nc, x, y, rep_id, entered_at, loaded_at), epoch_us(entered_at) AS entered_us, epoch_us(loaded_at) AS loaded_us FROM g WHERE id = rep_id")
def p1_collapsed(s, d):
    """Whole records, times in microseconds since 1970."""
    out = collapse(t(s, d, "addr"), "id", ADDR, Scratch(s))
    return out.withColumns({"entered_us": F.unix_micros("entered_at"), "loaded_us": F.unix_micros("loaded_at")}).drop("entered_at", "loaded_at")


@query("p3_found")
def p3_found(s, d):
    return map_to_list(t(s, d, "addr_entry"), "entry_id", "city", "state", t(s, d, "ref_city"), scratch=Scratch(s))


@query("p3_mapped")
def p3_mapped(s, d):
    """Every entry with the place it means, typed as it was; null where none is meant."""
    e, ref = t(s, d, "addr_entry"), t(s, d, "ref_city").select("ref_id", F.col("city").alias("ref_city"), F.col("state").alias("ref_state"))
    far = map_to_list(e, "entry_id", "city", "state", t(s, d, "ref_city"), scratch=Scratch(s))
    same = ref.select("ref_id", F.col("ref_city").alias("city"), F.col("ref_state").alias("state"))
    j = e.join(far.withColumnRenamed("ref_id", "_far"), "entry_id", "left").join(F.broadcast(same), ["city", "state"], "left")
    return j.withColumn("ref_id", F.coalesce("ref_id", "_far")).drop("_far").join(F.broadcast(ref), "ref_id", "left")


_P5 = """WITH RECURSIVE v AS (SELECT rec_id, 'z' || zip AS x FROM equivalence WHERE zip IS NOT NULL UNION ALL SELECT rec_id, 'c' || city FROM equivalence WHERE city IS NOT NULL),
m AS (SELECT x, min(rec_id) AS k FROM v GROUP BY 1), e AS (SELECT DISTINCT a.k AS p, b.k AS q FROM v x JOIN v y USING (rec_id) JOIN m a ON a.x = x.x JOIN m b ON b.x = y.x WHERE a.k <> b.k),
r(p, q) AS (SELECT k, k FROM m UNION SELECT e.q, r.q FROM r JOIN e ON e.p = r.p AND r.q < e.q),
l AS (SELECT p, min(q) AS g FROM r GROUP BY 1), f AS (SELECT v.rec_id, min(l.g) AS group_id FROM v JOIN m USING (x) JOIN l ON l.p = m.k GROUP BY 1)
SELECT rec_id, group_id FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM f) WHERE n > 1"""


@query("p5_found", _P5)
def p5_found(s, d):
    return record_groups(t(s, d, "equivalence"), "rec_id", ["zip", "city"], Scratch(s))


@query("p5_sizes", f"SELECT group_id, count(*) AS records FROM ({_P5}) GROUP BY 1")
def p5_sizes(s, d):
    """Every group with its size, the largest first."""
    g = record_groups(t(s, d, "equivalence"), "rec_id", ["zip", "city"], Scratch(s))
    return g.groupBy("group_id").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "group_id")


@query("p7_containers")
def p7_containers(s, d):
    """Every document in containers of up to 4,096 tokens."""
    return pack(Scratch(s).write(token_sizes(t(s, d, "documents"), "doc_id", "text"), "sizes"), "doc_id")


_WORDS = "regexp_extract_all(lower(regexp_replace({0}, '\\\\\\p{{L}}*\\*?', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "SELECT {k}, list_aggregate(w[i:i + 11], 'string_agg', ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {k}, {w} AS w FROM {t}))"


@query("p7_checks", "SELECT count(*) AS documents, 0::BIGINT AS tokens_lost, 0::BIGINT AS overfull, 0::BIGINT AS divided_that_fit FROM documents")
def p7_checks(s, d):
    """What must hold for the containers: every document is in, no token is lost, none holds too much, none is divided that fits."""
    scratch = Scratch(s)
    sizes = scratch.write(token_sizes(t(s, d, "documents"), "doc_id", "text"), "sizes")
    rows = scratch.write(pack(sizes, "doc_id"), "packed")
    over = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("u")).agg(F.count_if(F.col("u") > 4096).alias("overfull"))
    each = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("u"), F.max("n_parts").alias("parts"))
    each = each.agg(F.count("*").alias("documents"), F.sum("u").alias("u"), F.count_if((F.col("parts") > 1) & (F.col("u") <= 4096)).alias("divided_that_fit"))
    j = each.join(F.broadcast(over)).join(F.broadcast(sizes.agg(F.sum("n_tokens").alias("all"))))
    return j.select("documents", (F.col("all") - F.col("u")).alias("tokens_lost"), "overfull", "divided_that_fit")


_ITEMS = _GRAMS.format(k='item_id', w=_WORDS.format('text'), t='eval_items')
_P8_REPORT = f"""WITH i AS (SELECT DISTINCT item_id, g FROM ({_ITEMS})), j AS (SELECT item_id, doc_id, count(*) AS n, count(DISTINCT g) AS own FROM ({_GRAMS.format(k='doc_id', w=_WORDS.format('text'), t='documents')}) JOIN i USING (g) GROUP BY 1, 2)
SELECT item_id, count(*) AS documents, sum(n)::BIGINT AS passages, max(own / (SELECT count(*) FROM i WHERE i.item_id = j.item_id)) AS most FROM j GROUP BY 1"""
_P8 = f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(k='doc_id', w=_WORDS.format('text'), t='documents')}) JOIN ({_GRAMS.format(k='item_id', w=_WORDS.format('text'), t='eval_items')}) USING (g)"


@query("p7_summary")
def p7_summary(s, d):
    """Containers by capacity, the tokens in them and the space left unused."""
    rows = pack(Scratch(s).write(token_sizes(t(s, d, "documents"), "doc_id", "text"), "sizes"), "doc_id")
    each = rows.groupBy("container_id", "capacity").agg(F.sum("n_tokens").alias("used"))
    return each.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("used"), F.sum(F.col("capacity") - F.col("used")).alias("unused"))


@query("p8_found", _P8)
def p8_found(s, d):
    return leaks(t(s, d, "documents"), "doc_id", "text", t(s, d, "eval_items"), "item_id", "text", Scratch(s)).select("doc_id", "item_id")


@query("p8_report", _P8_REPORT)
def p8_report(s, d):
    """For each leaked item its documents, the matching passages and the largest share of the item in one document."""
    found = leaks(t(s, d, "documents"), "doc_id", "text", t(s, d, "eval_items"), "item_id", "text", Scratch(s))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.sum("passages").alias("passages"), F.max("contained").alias("most"))


@query("p9_found")
def p9_found(s, d):
    return residue(t(s, d, "documents"), "doc_id", "text", "source", Scratch(s)).select("doc_id")


@query("p9_clean")
def p9_clean(s, d):
    """The corpus without the marked documents, whole records."""
    docs = t(s, d, "documents")
    return without_residue(docs, residue(docs, "doc_id", "text", "source", Scratch(s)), "doc_id")
