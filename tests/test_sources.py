import json

import pytest

from siltstone.plans import catalog
from siltstone.sources import files, text_tables
from siltstone.streaming import windows


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id;name;\n1;"a;b";x\n\n2;;y\n')
    df = files.load(spark, str(p))
    assert df.columns == ["id", "name"] and [tuple(r) for r in df.collect()] == [("1", "a;b"), ("2", None)]
    files.write_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out"), ",").orderBy("id").collect()] == [("1", "a;b"), ("2", None)]
    (tmp_path / "e.csv").write_text("\n")
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "e.csv"))


def test_csv_lines_go_only_if_every_cell_is_blank(spark, tmp_path):
    (tmp_path / "b.csv").write_text("a,b\n1,x\n \t,\u3000\n\u00a0,y\n\u00a0,\n2,\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [("1", "x"), ("\u00a0", "y"), ("2", None)]


def test_csv_scan_keeps_cells_as_they_are(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    names = [" lead", "trail ", "\ttab\t", " ", '"', 'q"q', "a,b", "a\nb", "a\r\nb", "a\rb", "back\\", None, "\u3000", "null", "x\0y"]
    rows = [(4 * i + k, name) for i, name in enumerate(names) for k in (0, 1)] + [(None, "x"), (-3, "y")]
    spark.createDataFrame(rows, "n_nationkey int, n_name string").coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    con = duckdb.connect()
    con.execute(f"create view nation as select * from '{tmp_path}/nation.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["csv_scan"](spark, str(tmp_path)).select("id", "_cname", "note").collect()]
    assert sorted(got, key=repr) == sorted(con.execute(catalog.SQL["csv_scan"]).fetchall(), key=repr) and len(got) == len(rows)


def test_json(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"a": 1, "b": {"c": "", "d": {"e": {"f": {"g": 1}}}}, "l": [1]}, {"a": 2}]))
    df = files.load(spark, str(p))
    assert set(df.columns) == {"a", "b_c", "b_d_e", "l"} and [(r["a"], r["b_c"], r["l"]) for r in df.orderBy("a").collect()] == [(1, None, None), (2, None, None)]
    with pytest.raises(ValueError):
        files.load(spark, "x.pdf")


def test_tables_in_text(spark):
    text = "intro\n| a | b |\n|---|---|\n| 1 | 2 |\nend\n\nx  y  z\n1  2  3\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "no table here")], "doc_id int, text string")
    got = [(r["doc_id"], r["row"], r["cells"]) for r in text_tables.table_rows(df, "doc_id", "text").orderBy("doc_id", "table", "row").collect()]
    assert got == [(1, 0, ["a", "b"]), (1, 1, ["1", "2"]), (1, 0, ["x", "y", "z"]), (1, 1, ["1", "2", "3"])]


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 10} 00:{i % 10:02d}:00", i % 3, "a", 1.0) for i in range(40)] + [(99, "2024-02-01 00:00:00", 0, "a", 1.0)]
    src = str(tmp_path / "src")
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    df.repartition(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    windows.write(windows.tumbling(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    done = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()]
    assert done == [tuple(r) for r in windows.tumbling(df).filter("start < '2024-02-01'").orderBy("start").collect()] and len(done) == 4


def test_columns_that_begin_like_made_up_names(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,_cost,_city,,_c9\n1,2,x,gone,y\n")
    df = files.load(spark, str(tmp_path / "c.csv"))
    assert df.columns == ["id", "_cost", "_city", "_c9"] and tuple(df.first()) == ("1", "2", "x", "y")
    assert files.dataset_name("/a/b.xlsx", "S 1") == "b.xlsx (S 1)"


def test_tables_are_read_from_texts():
    read = text_tables.read_text
    aligned = "Product      Quantity    Revenue\nProduct A          20     50,000\nProduct B          15     38,000"
    page = f"QUARTERLY SALES REPORT\nPrepared by finance.\n\n{aligned}\n\nAll figures are subject to audit."
    (t,), rest = read(page)
    assert (t["columns"], t["types"], t["has_header"]) == (["Product", "Quantity", "Revenue"], ["text", "number", "number"], True) and len(t["rows"]) == 2
    assert "SALES REPORT" in rest and "audit" in rest and "Product A" not in rest and 0 < t["start_line"] < t["end_line"]
    bars = "Product   | Quantity | Revenue\nProduct A |       20 |  50,000\nProduct B |          |  38,000\nProduct C |       42 | 112,500"
    assert read(bars)[0][0]["rows"][1] == ["Product B", None, "38000"]
    assert read("| P | Q |\n| --- | --: |\n| a | 1 |\n| b | 2 |")[0][0]["rows"] == [["a", "1"], ["b", "2"]]
    assert read("Ada      99\nGrace    97\nAlan     95")[0][0]["columns"] == ["column_1", "column_2"]
    names = read("Name  Name  Name\na     b     c\nd     e     f")[0][0]["columns"]
    assert len(set(names)) == 3
    assert all(c.strip() for c in read("Product |  | Revenue\nA       | x | 10\nB       | y | 20")[0][0]["columns"])
    again = read(aligned + "\nProduct      Quantity    Revenue\nProduct C          42    112,500")[0][0]
    assert again["repeated_headers"] == 1 and len(again["rows"]) == 3
    ragged = read("A    B    C\n1    2    3\n4    5\n6    7    8\n9    10   11")[0][0]
    assert 0.5 < ragged["confidence"] < t["confidence"] and t["confidence"] > 0.7
    assert read("A  B  C\n1  2\n3  4  5  6\n7\n8  9  10  11  12")[0] == [] and read("Title  Here\nSub    Line")[0] == []
    assert read(None) == ([], "") and read("Some text.\nMore text.")[0] == []
    assert len(read("R    V\nE    5\nA    3\n\nNext:\n\nT    P\nS    1\nU    8")[0]) == 2
    assert [text_tables.cell_number(x) for x in ("1,200", "(5)", "2026-01-15", "15/01/2026", "Room 4")] == [1200, -5, None, None, None]


def test_database_columns_and_names(spark):
    df = spark.sql("SELECT DATE'2024-02-03' AS d, TIMESTAMP'2024-02-03 04:05:06' AS t, 1.5D AS x, array(1, NULL) AS l, named_struct('a', 1) AS s, X'0aff' AS b, INTERVAL '2' DAY AS i, CAST(NULL AS DATE) AS n")
    out = files.plain_columns(df)
    assert tuple(out.first())[:6] == ("2024-02-03", "2024-02-03", 1.5, "[1,null]", '{"a":1}', "0AFF") and out.first()["n"] is None and dict(out.dtypes)["i"] == "string"
    assert files.quoted_table("jdbc:postgresql://h/d", 'a.odd"name') == '"a"."odd""name"' and files.quoted_table("jdbc:mysql://h/d", "a.b`c") == "`a`.`b``c`"


def test_guard_against_java_and_files():
    import pytest

    from siltstone.operators.query import guard_read_only

    for bad in ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "select JAVA_METHOD ('a', 'b')", "SELECT try_reflect('a')", "SELECT * FROM parquet.`/etc`", "SELECT * FROM csv . `x`", "SELECT * FROM workbook.`x.xlsx`"):
        with pytest.raises(ValueError, match="not allowed"):
            guard_read_only(bad)
    assert guard_read_only("SELECT 'reflect(x)' AS a, t.`parquet` FROM t") and guard_read_only("SELECT json FROM t")
