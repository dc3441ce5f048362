from pyspark.sql import functions as F
import pytest

from siltstone.functions import cells, names, stats


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", column(F.col("t"))).orderBy("i").collect()]


def test_numbers(spark):
    texts = ["$1,200.50", "₦2,000", "50%", "(1,200)", "0x10", "NaN", "true", None, "", "-", "1e3", "5d", "1e999", " 7 ", "₹5", "(-5)", ".5", "1.2.3"]
    assert values(spark, cells.number, texts) == [1200.5, 2000, 50, -1200, None, None, None, None, None, None, 1000, None, None, 7, None, 5, 0.5, None]


def test_blanks_and_trimming(spark):
    texts = [None, "", "  ", " \t﻿", "a", "  a  b "]
    assert values(spark, cells.is_blank, texts) == [True, True, True, True, False, False]
    assert values(spark, cells.squeeze, texts[4:]) == ["a", "a b"]


def test_dates(spark):
    texts = ["2024-01-05", "2024-01-05T10:20:30Z", "2024/1/5", "1/5/2024", "5-1-2024", "5.1.2024", "May", "2024-02-30", "44391"]
    got = values(spark, lambda c: F.date_format(cells.strict_date(c), "yyyy-MM-dd"), texts)
    assert got == ["2024-01-05", "2024-01-05", "2024-01-05", "2024-01-05", "2024-05-01", "2024-05-01", None, None, None]
    assert values(spark, cells.serial_day, ["44391", "12", "x", None]) == ["2021-07-14", "12", "x", None]


def test_case_and_encoding(spark):
    assert values(spark, cells.standard_case, ["JAMES MONROE", "john c. calhoun", "COMMANDER-IN-CHIEF", "McDonald", "o'neil"]) == ["James Monroe", "John C. Calhoun", "Commander-In-Chief", "McDonald", "O'Neil"]
    assert values(spark, cells.fix_encoding, ["cafÃ©", "â€“", "plain é", None]) == ["café", "–", "plain é", None]
    twice = "é".encode().decode("latin-1").encode().decode("latin-1")
    assert values(spark, cells.fix_encoding, [cells._garbled(cells._garbled("é")), twice]) [0] == "é"
    assert values(spark, cells.category_key, [" New - York ", "new-york"]) == ["new-york", "new-york"]


def test_names():
    assert [names.role_of(n) for n in ("Total_Revenue", "TotalRevenue", "unit price", "customer_id", "is_active", "foo")] == ["revenue", "revenue", "unitPrice", "customer", "flag", None]
    assert names.is_identifier("S.No.") and names.is_identifier("order_id") and not names.is_identifier("amount")
    assert names.matching_key("Order_Date") == "order date" and names.spaced("orderDate") == "order date"
    assert names.plural("Category") == "Categories" and names.title("customer_id", True) == "Customer"


def test_statistics():
    assert stats.round2(1.005) == 1.0 and stats.round2(2.675) == 2.67 and stats.round2(-0.125) == -0.13
    assert stats.nearest(2.5) == 3 and stats.nearest(-2.5) == -2
    assert stats.chi2_tail(3.841, 1) == pytest.approx(0.05, abs=1e-4) and stats.chi2_tail(11.345, 3) == pytest.approx(0.01, abs=1e-4)
    assert stats.trend([1, 2, 3]) == (1.0, 1.0) and stats.trend([5, 5, 5]) == (0.0, 0.0)
    assert stats.percent_change(0, 5) is None and stats.percent_change(-4, -2) == 50


def test_numbers_in_steps_are_those_of_one_expression(spark):
    texts = ["(5)", "(-5)", "()", "(", "$1,234.5", " 7 % ", "1e999", "(1e999)", "x", "", None, "5\u0085", ".5", "5.", "+3", "((4))", "-0", "01", "NaN", "1_0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cells.trim(F.col("t")).alias("s"))
    got = cells.with_numbers(df, {"n": "s"}).select("n", cells.number(F.col("t")).alias("m"), F.col("n").eqNullSafe(F.col("m")).alias("same"))
    rows = got.collect()
    assert len(rows) == len(texts) and all(r["same"] for r in rows)
