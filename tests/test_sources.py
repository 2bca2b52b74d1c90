from depguard import cli
from depguard.rules import parse_rule
from depguard.sources import logical_name, read_csv_ints, read_jdbc, read_lines, read_table, read_text_with_header, write_repaired, write_report
from depguard.streaming import check_stream, fd_stream_counts
from depguard.functions.text import word_count


def test_text_with_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,2,3\n4,,6\n7,8,\n9\n")
    df = read_text_with_header(spark, str(tmp_path / "a.txt"), "adID, appPlatform ,camgaignID")
    assert df.columns == ["adID", "appPlatform", "camgaignID"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3"), ("4", "", "6"), ("7", "8", ""), ("9", None, None)]


def test_ints_and_sinks(spark, tmp_path):
    (tmp_path / "b.csv").write_text("1,2\n3,x\n")
    df = read_csv_ints(spark, str(tmp_path / "b.csv"), ["id", "a"])
    assert [tuple(r) for r in df.collect()] == [(1, 2), (3, None)]
    write_report(df, str(tmp_path / "out"))
    write_report(df.limit(0), str(tmp_path / "out"))  # what is there stays
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    write_repaired(df.withColumnRenamed("a", "_visited"), str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "rep")).columns == ["id"]
    assert logical_name("u-1", 7, "my table") == "u_1_7_my_table"


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "c.txt").write_text("1,x\n1,x\n1,y\n2,z\n")
    assert cli.main(["detect", str(tmp_path / "c.txt"), "fd", "k->v", "--header", "k,v"], spark) == 0
    assert cli.main(["repair", str(tmp_path / "c.txt"), "fdset", "k->v", "--header", "k,v", "--target", str(tmp_path / "fixed")], spark) == 0
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "fixed")).collect()) == [("1", "x"), ("1", "x"), ("1", "x"), ("2", "z")]
    assert "k->v" in capsys.readouterr().out


def test_word_count(spark):
    df = spark.createDataFrame([("a b  a",), (None,), ("",)], "t string")
    assert sorted(tuple(r) for r in word_count(df, "t").collect()) == [("", 2), ("a", 2), ("b", 1)]


def test_streams(spark, tmp_path):
    base = spark.createDataFrame([(1, 10, 50), (2, 20, 40)], "id int, a int, c int")
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(9, 15, 45)], "id int, a int, c int").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, a int, c int").parquet(str(tmp_path / "in"))
    q = check_stream(stream, base, parse_rule("[a>]->[c>]", "pod"), "id", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select("add_id", "base_id", "direction").collect()
    assert sorted(map(tuple, got)) == [(9, 1, 1), (9, 2, -1)]
    ev = spark.createDataFrame([("2024-01-01 01:00:00", "x", "y"), ("2024-01-01 02:00:00", "x", "z"), ("2024-01-02 02:00:00", "x", "z")], "ts string, l string, r string").selectExpr("ts::timestamp ts", "l", "r")
    assert sorted(r.n for r in fd_stream_counts(ev, "ts", "l", "r", "90 days").collect()) == [1, 1, 1]


def test_catalog_tables(spark, small):
    n = read_table(spark, f"{small}/nation.parquet")
    try:
        write_repaired(n.withColumn("_visited", n.n_nationkey > 3), "depguard_nation")
        write_report(n.limit(0), "depguard_nation")  # what is there stays
        back = read_table(spark, "depguard_nation")
        assert back.columns == n.columns and sorted(back.collect()) == sorted(n.collect())
        assert cli.main(["detect", "depguard_nation", "fd", "n_regionkey->n_name", "--target", "depguard_report"], spark) == 0
        assert read_table(spark, "depguard_report").first().total == 25
    finally:
        for name in ("depguard_nation", "depguard_report"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a b\n\n b\n")
    assert sorted(tuple(r) for r in word_count(read_lines(spark, str(tmp_path / "l.txt")), "value").collect()) == [("", 2), ("a", 1), ("b", 2)]


def test_jdbc_options(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    seen = {}
    monkeypatch.setattr(DataFrameReader, "format", lambda self, kind: seen.update(format=kind) or self)
    monkeypatch.setattr(DataFrameReader, "options", lambda self, **o: seen.update(o) or self)
    monkeypatch.setattr(DataFrameReader, "load", lambda self: "loaded")
    assert read_jdbc(spark, "jdbc:postgresql://h/d", "t", "id", (0, 10**9), 64, user="u") == "loaded"
    assert seen == {"format": "jdbc", "url": "jdbc:postgresql://h/d", "dbtable": "t", "user": "u", "partitionColumn": "id", "lowerBound": 0, "upperBound": 10**9, "numPartitions": 64}


def test_numbers_and_orders_from_text(spark, tmp_path, capsys):
    (tmp_path / "base.txt").write_text("1,9,50\n2,10,40\n")
    (tmp_path / "add.txt").write_text("9,9.5,45\n")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("detect", tmp_path / "base.txt", "dc", "A.a<B.a", "--header", "id,a,c", "--key", "id", "--output", "pairs", "--numeric", "a", "--target", tmp_path / "n")
    assert [(r.A_id, r.B_id) for r in spark.read.parquet(str(tmp_path / "n")).collect()] == [("1", "2")]  # as text, 10 comes before 9
    run("detect", tmp_path / "add.txt", "pod", "[a>]->[c>]", "--header", "id,a,c", "--key", "id", "--output", "pairs", "--base", tmp_path / "base.txt", "--target", tmp_path / "p")
    assert sorted((r.add_id, r.base_id, r.direction) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("9", "1", 1), ("9", "2", -1)]
    run("detect", tmp_path / "base.txt", "pod", "[a>]->[c>]", "--header", "id,a,c", "--key", "id")
    assert "2" in capsys.readouterr().out
