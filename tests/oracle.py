"""Spark rows against SQL rows on the small tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings addr addr_entry rdddf_raw equivalence hospital tax_base tax_add ref_city eval_items".split()


def connection(sf):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None:
            return "\0"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def same(spark_df, sql, sf):
    con = connection(sf)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = canon(cur.fetchall(), names)
    got = canon([tuple(r) for r in spark_df.collect()], spark_df.columns)
    assert sorted(names) == sorted(spark_df.columns)
    assert got == want
