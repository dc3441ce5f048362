"""Workbooks: cells of all kinds written by hand, folders, limits, and a round trip."""

import io
import zipfile

import pytest

from siltstone.sources import workbooks as wb

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
MAIN, LINKS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def by_hand(path, sheets, strings=(), prefix=""):
    """A workbook whose sheets' XML is given; with a prefix, as some writers name tags."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="a{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="x">' + "".join(f'<Relationship Id="a{k}" Target="{"/xl/" if k else ""}worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, xml in enumerate(sheets.values()):
            space = f'xmlns:{prefix[:-1]}="{MAIN}"' if prefix else f'xmlns="{MAIN}"'
            z.writestr(f"xl/worksheets/s{k}.xml", f"{HEAD}<{prefix}worksheet {space}>{xml}</{prefix}worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f'{HEAD}<sst xmlns="{MAIN}">' + "".join(f"<si>{x}</si>" for x in strings) + "</sst>")


STRINGS = ("<t>Name</t>", "<r><t>Ri</t></r><r><rPr/><t xml:space='preserve'>ch </t></r><rPh><t>no</t></rPh>", "<t>a_x000D_b_x005F_</t>", "<t/>")
CELLS = (
    '<dimension ref="B1:G6"/><sheetData>'
    '<row r="1"><c r="B1" t="s"><v>0</v></c><c r="D1" t="s"><v>0</v></c><c r="F1" t="inlineStr"><is><t>When</t></is></c><c r="G1"><v>2024</v></c></row>'
    '<row r="2"><c r="B2" t="s"><v>1</v></c><c r="C2" t="b"><v>1</v></c><c r="D2"><v>1.50</v></c><c r="E2" t="e"><v>#REF!</v></c><c r="F2" s="3"><v>45000.25</v></c><c r="G2"><v>1E-5</v></c></row>'
    '<row r="3"/><row r="4"><c r="B4" t="s"><v>3</v></c></row>'
    '<row r="5"><c r="B5" t="s"><v>2</v></c><c r="C5" t="b"><v>0</v></c><c r="D5" t="str"><f>A1</f><v>x &amp; y</v></c><c r="F5"><v>3</v></c><c r="H5"><v>7</v></c></row>'
    "<row><c><v>9</v></c><c/><c><v>12345678901234567890</v></c></row></sheetData>"
)


@pytest.fixture
def book(tmp_path):
    by_hand(tmp_path / "a.xlsx", {"One &amp; only": CELLS, "Empty": "<sheetData/>", "Heads": '<sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>h</t></is></c></row></sheetData>', "Late": '<sheetData><row r="3"><c r="B3"><v>1</v></c><c r="C3"><v>2</v></c></row></sheetData>'}, STRINGS)
    return str(tmp_path / "a.xlsx")


def test_cells_of_all_kinds(spark, book):
    df = wb.read_workbook(spark, book, "One & only")
    # a cell without a reference stands in column A, so the range begins there, before what the dimension says
    assert df.dtypes == [("__EMPTY", "double"), ("Name", "string"), ("__EMPTY_1", "string"), ("Name_1", "string"), ("__EMPTY_2", "string"), ("When", "double"), ("2024", "double"), ("__EMPTY_3", "double")]
    assert [tuple(r) for r in df.collect()] == [
        (None, "Rich ", "true", "1.5", None, 45000.25, 1e-5, None),
        (None, "a\rb_", "false", "x & y", None, 3.0, None, 7.0),
        (9.0, None, "12345678901234567000", None, None, None, None, None),
    ]
    rows = wb.sheet_rows(spark, book, "One & only").orderBy("row").collect()
    assert [r["row"] for r in rows] == [0, 1, 4, 5] and rows[1]["cells"]["Name_1"].asDict() == {"kind": "n", "text": "1.5"}


def test_sheets_without_rows_or_names(spark, book):
    assert wb.read_workbook(spark, book, "Heads").columns == ["h"] and wb.read_workbook(spark, book, "Heads").count() == 0
    assert [tuple(r) for r in wb.read_workbook(spark, book, "Late").select("__EMPTY", "__EMPTY_1").collect()] == [(1.0, 2.0)]
    with pytest.raises(ValueError, match="no columns"):
        wb.read_workbook(spark, book, "Empty")


def test_sheets_are_listed(spark, book):
    assert [(r["sheet"], r["position"]) for r in wb.list_sheets(spark, book).orderBy("position").collect()] == [("One & only", 0), ("Empty", 1), ("Heads", 2), ("Late", 3)]


def test_names_that_are_missing_or_taken():
    assert wb.header(["a", None, "a", "a_1", None, "a", "__EMPTY"]) == ["a", "__EMPTY", "a_1", "a_1_1", "__EMPTY_1", "a_2", "__EMPTY_2"]


@pytest.mark.parametrize(("x", "text"), [(1.0, "1"), (-0.5, "-0.5"), (1e-5, "0.00001"), (1.5e-7, "1.5e-7"), (1e21, "1e+21"), (1.25e20, "125000000000000000000"), (0.1, "0.1"), (123456.789, "123456.789")])
def test_numbers_as_text(x, text):
    assert wb.number_text(x) == text


def test_tags_with_a_prefix(tmp_path):
    by_hand(tmp_path / "p.xlsx", {"S": '<x:sheetData><x:row r="1"><x:c r="A1" t="inlineStr"><x:is><x:t>n</x:t></x:is></x:c></x:row><x:row r="2"><x:c r="A2"><x:v>4</x:v></x:c></x:row></x:sheetData>'}, prefix="x:")
    with open(tmp_path / "p.xlsx", "rb") as f:
        assert list(wb.Workbook(f).records("S")) == [(0, {"n": ("#", "0")}), (1, {"n": ("n", "4")})]


def test_files_of_a_folder_differ_in_columns(spark, tmp_path):
    for name, rows, columns in (("b", [(1.5, True)], "k double, flag boolean"), ("a", [(1, "x"), (2, None)], "k int, s string"), ("c", [("text",)], "late string")):
        with open(tmp_path / f"{name}.xlsx", "wb") as f:
            df = spark.createDataFrame(rows, columns)
            wb.write_rows(f, df.columns, ["n" if t in ("int", "double") else "b" if t == "boolean" else "s" for _, t in df.dtypes], iter(rows))
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    (tmp_path / "notes.txt").write_text("x")
    df = wb.read_workbook(spark, str(tmp_path))
    assert df.dtypes == [("k", "double"), ("s", "string"), ("flag", "boolean"), ("late", "string")]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1.0, "x", None, None), (2.0, None, None, None), (1.5, None, True, None), (None, None, None, "text")], key=str)
    assert wb.list_sheets(spark, str(tmp_path)).count() == 3


def test_round_trip_of_many_rows_and_sheets(spark, tmp_path):
    odd = ["", " ", "a<b&c>\"d\"", "_x0041_", "tab\tline\nfeed\r\x07", "日本 \U0001f600", "1.0", "TRUE", "x" * 40000]
    rows = [(i, None if i % 5 == 0 else i / 7, odd[i % len(odd)], i % 2 == 0 if i % 3 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "i long, x double, s string, b boolean").repartition(3)
    wb.write_workbooks(df, str(tmp_path / "out"), "Data")
    back = wb.read_workbook(spark, f"file://{tmp_path}/out", "Data")
    assert back.dtypes == [("i", "double"), ("x", "double"), ("s", "string"), ("b", "boolean")]
    want = [(float(i), x, s or None, b) for i, x, s, b in rows]
    assert sorted(map(tuple, back.collect())) == want
    assert wb.list_sheets(spark, str(tmp_path / "out")).count() == 3
    wb.write_workbooks(df.limit(0), str(tmp_path / "out"))
    assert wb.read_workbook(spark, str(tmp_path / "out")).count() == 4000


def test_long_tables_go_to_several_sheets():
    out = io.BytesIO()
    wb.write_rows(out, ["n", " "], ["n", "s"], iter([(k, "x") for k in range(25)]), "Numbers", sheet_rows=10)
    book = wb.Workbook(io.BytesIO(out.getvalue()))
    assert list(book.sheets) == ["Numbers", "Numbers 2", "Numbers 3"]
    got = [r for s in book.sheets for r in book.records(s)]
    assert len(got) == 28 and got[0] == (0, {"n": ("#", "0"), "__EMPTY": ("#", "1")}) and got[-1] == (5, {"n": ("n", "24"), "__EMPTY": ("s", "x")})


def test_limits_are_errors_and_do_not_cut(spark, book, tmp_path):
    assert wb.read_workbook(spark, book, "One & only", row_limit=3).count() == 3
    for options, said in (({"row_limit": 2}, "more than 2 rows"), ({"max_bytes": 10}, "larger than 10 bytes")):
        with pytest.raises(Exception, match=said):
            wb.read_workbook(spark, book, "One & only", **options)
    with pytest.raises(Exception, match="no sheet"):
        wb.read_workbook(spark, book, "Gone")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="not a workbook"):
        wb.read_workbook(spark, str(tmp_path / "bad.xlsx"))
    with pytest.raises(Exception, match="no workbooks|FileNotFound"):
        (tmp_path / "none").mkdir()
        wb.read_workbook(spark, str(tmp_path / "none"))


def test_bytes_read_by_spark_give_the_same(spark, book, monkeypatch):
    want = [tuple(r) for r in wb.read_workbook(spark, book, "One & only").collect()], wb.list_sheets(spark, book).count()
    monkeypatch.setattr(wb, "_reachable", lambda path: False)
    assert ([tuple(r) for r in wb.read_workbook(spark, book, "One & only").collect()], wb.list_sheets(spark, book).count()) == want
    with pytest.raises(Exception, match="more than 2 rows"):
        wb.read_workbook(spark, book, "One & only", row_limit=2)


def test_a_partition_of_more_rows_than_a_sheet_holds_is_read_back_whole(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "concat('t', id) AS t").coalesce(1)
    wb.register(spark)
    df.write.format("workbook").option("sheet", "S").option("sheetRows", 10).mode("append").save(str(tmp_path / "w"))
    assert sorted(map(tuple, wb.read_workbook(spark, str(tmp_path / "w"), "S").collect())) == [(float(k), f"t{k}") for k in range(25)]
    assert wb.list_sheets(spark, str(tmp_path / "w")).count() == 3
