from tabsift.api import *  # noqa: F403
from tabsift.sources.xlsx import displayed, to_xlsx


def test_csv(spark):
    t = parse_csv(spark, "a,b,c\n1,2\n3,4,5,6\n , ,\n\n")
    assert (t.headers, t.rows()) == (["a", "b", "c"], [["1", "2", ""], ["3", "4", "5"]])
    assert parse_csv(spark, "name,,city\nx,y,z").headers == ["name", "col1", "city"]
    assert parse_csv(spark, "1,2\n3,4,5", has_header=False).headers == ["col0", "col1", "col2"]
    assert parse_csv(spark, "a;b\n1;2\n3;4").meta["delimiter"] == ";"
    assert parse_csv(spark, "﻿a\tb\n1\t2").headers == ["a", "b"]
    assert parse_csv(spark, 'a,b\n"x\ny","q""q"').rows() == [["x\ny", 'q"q']]
    assert parse_csv(spark, "a,a\n1,2").headers == ["a", "a"]


def test_to_csv(spark):
    assert to_csv(table_from_rows(spark, ["a", "b"], [("x,y", 'q"'), ("", " z")])) == 'a,b\n"x,y","q"""\n," z"'
    assert to_csv(table_from_rows(spark, ["a"], [])) == "a"


def test_csv_files(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('h,,k\n1," a, b ",\n , ,\n2,c\n')
    t = read_csv(spark, str(p))
    assert (t.headers, t.rows()) == (["h", "col1", "k"], [["1", " a, b ", ""], ["2", "c", ""]])
    write_csv(t, str(tmp_path / "out"))
    again = read_csv(spark, str(tmp_path / "out"))
    assert again.rows() == t.rows()


def test_parse_errors(spark):
    errors = lambda text, **more: parse_csv(spark, text, **more).meta["parse_errors"]
    assert errors("a,b\n1,2\n") == []
    assert errors('a,b\n1,"2\n3,4') == ["Quotes: Quoted field unterminated (row 1)"]
    assert errors('a,b\n1,"x"y\n') == ["Quotes: Trailing quote on quoted field is malformed (row 1)"]
    assert errors("a\n1\n") == ["Delimiter: Unable to auto-detect delimiting character; defaulted to ','"]
    assert errors("a\n1\n", delimiter=",") == []
    long = "x" * 200_000
    assert parse_csv(spark, f"a,b\n{long},2").rows() == [[long, "2"]]


def test_several_files_in_the_order_of_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.csv").write_text("id,v\n" + "\n".join(f"{i},b{i}" for i in range(3)) + "\n")
    (tmp_path / "in" / "a.csv").write_text("\n , \nid,v\n" + "\n".join(f"{i},{'a' * 50}" for i in range(400)) + "\n,\n7")
    (tmp_path / "in" / "c.csv").write_text("")
    (tmp_path / "in" / "d.csv").write_text("id,v\n")
    t = read_csv(spark, str(tmp_path / "in"))
    want = [[str(i), "a" * 50] for i in range(400)] + [["7", ""]] + [[str(i), f"b{i}"] for i in range(3)]
    assert t.headers == ["id", "v"] and t.rows() == want
    assert [r.rid for r in t.df.orderBy("rid").collect()] == list(range(len(want)))
    bare = read_csv(spark, str(tmp_path / "in" / "b.csv"), has_header=False)
    assert bare.headers == ["col0", "col1"] and bare.rows()[0] == ["id", "v"]
    assert read_csv(spark, str(tmp_path / "in" / "c.csv")).headers == [] and read_csv(spark, str(tmp_path / "in" / "d.csv")).rows() == []


def test_large_files_are_split(spark, tmp_path):
    (tmp_path / "x.csv").write_text("n,s\n" + "".join(f"{i},{'z' * (i % 60)}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        t = read_csv(spark, str(tmp_path / "x.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = t.df.orderBy("rid").collect()
    assert [(r.rid, r.c0, len(r.c1)) for r in rows] == [(i, str(i), i % 60) for i in range(20_000)]


def test_quoted_line_breaks_in_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x\ny, ""z"""\n"2",w\n', newline="")
    t = read_csv(spark, str(tmp_path / "x.csv"))
    assert t.rows() == [["1", 'x\ny, "z"'], ["2", "w"]] and t.meta["parse_errors"] == []
    (tmp_path / "y.csv").write_text('a,b\n1,2\n3,"4\n')
    assert read_csv(spark, str(tmp_path / "y.csv")).meta["parse_errors"] == ["Quotes: Quoted field unterminated (row 2)"]
    assert read_csv(spark, str(tmp_path / "y.csv"), has_header=False, delimiter=";").headers == ["col0"]


def test_written_tables_are_read_back(spark, tmp_path):
    import random

    r = random.Random(1)
    cells = ["", " a ", "b,c", 'q"q', '"', "x\ny", "é\u2028", "1\tz", "'", "\\", '\\"', "p\r\nq", "日本"]
    rows = [[str(i), *(r.choice(cells) for _ in range(3))] for i in range(2_000)]
    t = table_from_rows(spark, ["id", "same", "same", "la,st"], rows)
    write_csv(Table(t.headers, t.df.repartition(3)), str(tmp_path / "out"), files=5)
    again = read_csv(spark, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    assert again.headers == t.headers and again.rows() == rows and again.meta["parse_errors"] == []


def test_typed_frames(spark):
    t = from_dataframe(spark.sql("select 1e7D as x, cast(null as string) as y, -0.05D as z, date'2024-01-05' as d"))
    assert t.rows() == [["10000000", "", "-0.05", "2024-01-05"]]
    many = from_dataframe(spark.range(100, numPartitions=7).where("id % 3 = 0"))
    assert [(r.rid, r.c0) for r in many.df.orderBy("rid").collect()] == [(i, str(3 * i)) for i in range(34)]
    shuffled = from_dataframe(spark.range(50).repartition(5).distinct())
    assert sorted(r.rid for r in shuffled.df.collect()) == list(range(50))


def test_xlsx(spark):
    data = to_xlsx(["a", "", "c"], [[1, "x & y", 2.5], ["", "", ""], ["z", True, ""]])
    t = parse_xlsx(spark, data)
    assert t.headers == ["a", "col1", "c"] and t.rows() == [["1", "x & y", "2.5"], ["z", "True", ""]]
    assert parse_xlsx(spark, data, sheet="none").headers == []
    assert is_xlsx_filename("a.XLSM") and is_xlsx_filename("a.xls") and not is_xlsx_filename("a.csv")


def test_xlsx_files(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(to_xlsx(["a"], [[1]]))
    assert read_xlsx(spark, str(tmp_path / "b.xlsx")).rows() == [["1"]]


def test_number_formats():
    assert [displayed(x, f) for x, f in ((1234.5, "#,##0.00"), (0.125, "0.0%"), (45296, "yyyy-mm-dd"), (45296.5, "m/d/yy h:mm"), (3.0, "General"), (1 / 3, "General"))] == ["1,234.50", "12.5%", "2024-01-05", "1/5/24 12:00", "3", "0.3333333333"]


def test_stream_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1, a\n2,b\n")
    got = []
    stream = spark.readStream.schema("n string, s string").csv(str(tmp_path / "in"))
    report_batches(stream, lambda issues, n: got.extend(issues.collect()), checkpoint=str(tmp_path / "ck")).awaitTermination()
    assert [(r.type, r.column_name) for r in got] == [("whitespace_format", "s")]
