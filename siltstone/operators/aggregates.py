"""Counts, sums, histograms, date buckets and correlations over untyped columns."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators.query import ROW, col

if TYPE_CHECKING:
    from siltstone.operators.profile import ColumnProfile, Profile

DAY_SPAN = 92


def numeric(df: DataFrame, name: str) -> Column:
    return cells.as_number(col(name), dict(df.dtypes)[name])


def when(df: DataFrame, name: str) -> Column:
    """Timestamps of a column: its own, or those that its texts and serials show."""
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp", "date", "timestamp_ntz"):
        return col(name).cast("timestamp")
    return F.coalesce(cells.strict_date(col(name)), F.when(cells.is_serial(col(name)), cells.serial_day(col(name)).try_cast("timestamp")))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """name, value: rows of each trimmed text, blanks left out."""
    key = cells.trim(col(name))
    return df.filter(key != "").groupBy(key.alias("name")).agg(F.count("*").alias("value"))


def first_values(df: DataFrame, name: str) -> DataFrame:
    """name, value, first: as value_counts, with the number of the row where each value stands first; largest count first, ties by that row."""
    key = cells.trim(col(name))
    return df.filter(key != "").groupBy(key.alias("name")).agg(F.count("*").alias("value"), F.min(ROW).alias("first")).orderBy(F.desc("value"), "first")


def sum_column(df: DataFrame, measure: str) -> Column:
    return F.coalesce(F.sum(numeric(df, measure)), F.lit(0.0))


def count_values(name: str) -> Column:
    """Cells that are not blank."""
    return F.count_if(~cells.is_blank(col(name)))


def distinct_count(name: str) -> Column:
    return F.count_distinct(F.nullif(cells.trim(col(name)), F.lit("")))


def sum_product(df: DataFrame, a: str, b: str) -> Column:
    """Over the rows where both show a number."""
    return F.coalesce(F.sum(numeric(df, a) * numeric(df, b)), F.lit(0.0))


def distinct_list(df: DataFrame, name: str, most: int = 200) -> list[str] | None:
    """The distinct trimmed values in order, or None if there are more than ``most``."""
    key = cells.trim(col(name))
    got = df.select(key.alias("v")).filter("v != ''").distinct().limit(most + 1).collect()
    return sorted(r["v"] for r in got) if len(got) <= most else None


def sum_by(df: DataFrame, category: str, measure: str) -> DataFrame:
    """name, value: the measure's sum by trimmed text; rows that show no number are left out."""
    key, n = cells.trim(col(category)), numeric(df, measure)
    return df.select(key.alias("name"), n.alias("n")).filter((F.col("name") != "") & F.col("n").isNotNull()).groupBy("name").agg(F.sum("n").alias("value"))


def aggregate_by(df: DataFrame, category: str, measure: str | None, kind: str = "sum", first: bool = False) -> DataFrame:
    """name, value for sum, avg, count, min or max; sums and averages to two places. With ``first`` also the row in which the name stands first."""
    key, at = cells.trim(col(category)).alias("name"), [F.col(ROW)] * first
    also = [F.min(ROW).alias("first")] * first
    if kind == "count" or measure is None:
        return df.select(key, *at).filter("name != ''").groupBy("name").agg(F.count("*").cast("double").alias("value"), *also)
    rows = df.select(key, numeric(df, measure).alias("n"), *at).filter("name != '' and n is not null")
    value = {"sum": F.round(F.sum("n"), 2), "avg": F.round(F.avg("n"), 2), "min": F.min("n"), "max": F.max("n")}[kind]
    return rows.groupBy("name").agg(value.alias("value"), *also)


def top_with_other(counts: DataFrame, n: int, other: str = "Other") -> DataFrame:
    """The ``n`` largest of (name, value), ties by first row if ``counts`` has it, else by name, and the sum of the rest under one name."""
    top = counts.orderBy(F.desc("value"), "first" if "first" in counts.columns else "name", "name").limit(n)
    rest = counts.join(top.select("name"), "name", "left_anti").agg(F.sum("value").alias("value")).filter("value is not null")
    return top.select("name", "value").unionByName(rest.select(F.lit(other).alias("name"), "value"))


def _edge(x: Column) -> Column:
    """An edge of a bin as a label has it: from 1,000 on whole with separators, else to one place."""
    return F.when(F.abs(x) >= 1000, F.format_number(F.round(x), 0)).otherwise(F.regexp_replace(F.format_number(F.round(x, 1), 1), r"\.0$", ""))


def labelled_histogram(df: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """label (``low–high``), n of exactly ``bins`` equal bins, in order; a constant column has one, labelled by its value."""
    found = histogram(df, name, bins, always=True)
    label = F.when(F.col("low") == F.col("high"), F.regexp_replace(F.col("low").cast("string"), r"\.0$", "")).otherwise(F.concat(_edge(F.col("low")), F.lit("–"), _edge(F.col("high"))))
    return found.orderBy("bin").select(label.alias("label"), "n")


def histogram(df: DataFrame, name: str, bins: int = 10, always: bool = False) -> DataFrame:
    """bin, low, high, n of equal bins over what shows a number, no more than values (at least 3) unless ``always``; the last is closed, empty ones are kept; a constant column has one."""
    v = df.select(numeric(df, name).alias("v")).filter("v is not null")
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("*")).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "bin int, low double, high double, n long")
    if low == high:
        return spark.createDataFrame([(0, low, high, n)], "bin int, low double, high double, n long")
    k = bins if always else min(bins, max(3, n))
    width = (high - low) / k
    at = F.least(F.lit(k - 1), F.floor((F.col("v") - low) / width)).cast("int")
    counts = v.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    edges = spark.range(k).select(F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * width).alias("low"), (F.lit(low) + (F.col("id") + 1) * width).alias("high"))
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def grain(df: DataFrame, date: str) -> str:
    """Day buckets for a span of up to 92 days, else months."""
    a, b = df.select(when(df, date).alias("t")).agg(F.min("t"), F.max("t")).first()
    return "yyyy-MM-dd" if a is None or (b - a).total_seconds() <= DAY_SPAN * 86400 else "yyyy-MM"


def bucket_by_date(df: DataFrame, date: str, measure: str | None = None, kind: str = "sum", form: str | None = None) -> DataFrame:
    """date, value by day or month: of the measure, or counts of rows without one. Buckets without rows are not made up."""
    form = form or grain(df, date)
    rows = df.select(F.date_format(when(df, date), form).alias("date"), (numeric(df, measure) if measure else F.lit(1.0)).alias("n")).filter("date is not null and n is not null")
    value = {"sum": F.sum("n"), "avg": F.avg("n"), "min": F.min("n"), "max": F.max("n"), "count": F.count("n").cast("double")}[kind]
    return rows.groupBy("date").agg(value.alias("value"))


def correlations(df: DataFrame, names: list[str], least: int = 10) -> DataFrame:
    """a, b, r, n of all pairs in one pass; r is null for under ``least`` pairs or without variance."""
    nums = df.select(*(numeric(df, n).alias(f"c{i}") for i, n in enumerate(names)))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    aggs = []
    for i, j in pairs:
        both = F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()
        a, b = F.when(both, F.col(f"c{i}")), F.when(both, F.col(f"c{j}"))
        aggs.append(F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.when((F.count(a) >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b)).alias("r"), F.count(a).alias("n")))
    return nums.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def cross_tab(df: DataFrame, rows: str, columns: str, measure: str | None = None, most: int = 14) -> DataFrame:
    """r, c, value over the most frequent values of both; pairs without rows are 0."""
    top_r = value_counts(df, rows).orderBy(F.desc("value"), "name").limit(most).select(F.col("name").alias("r"))
    top_c = value_counts(df, columns).orderBy(F.desc("value"), "name").limit(most).select(F.col("name").alias("c"))
    base = df.select(cells.trim(col(rows)).alias("r"), cells.trim(col(columns)).alias("c"), (numeric(df, measure) if measure else F.lit(1.0)).alias("n"))
    cells_ = base.join(F.broadcast(top_r), "r", "left_semi").join(F.broadcast(top_c), "c", "left_semi").groupBy("r", "c").agg(F.sum("n").alias("value"))
    grid = top_r.crossJoin(top_c)  # at most ``most`` by ``most`` rows
    return grid.join(cells_, ["r", "c"], "left").select("r", "c", F.coalesce("value", F.lit(0.0)).alias("value"))


def ranked(counts: DataFrame, by: str, value: str = "value", name: str = "name") -> DataFrame:
    """Rank within ``by``, largest first, ties by name; for counts that are few."""
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(value), name)))


def rare_values(df: DataFrame, name: str, most: int = 2, top: int = 3) -> DataFrame:
    """Values of at most ``most`` rows in a column whose commonest has ``top`` or more."""
    counts = value_counts(df, name)
    peak = counts.agg(F.max("value").alias("peak"))
    return counts.crossJoin(F.broadcast(peak)).filter((F.col("peak") >= top) & (F.col("value") <= most)).select("name", "value")


#: Rare values to review, and values that each may be merged into.
REVIEWED = 8


def review(df: DataFrame, names: list[str], most: int = 2, top: int = 3) -> DataFrame:
    """column, value, n, targets: rare values of columns whose commonest value has ``top`` rows and that have three values or more, in one pass over all columns.

    Targets are the column's values of ``top`` rows or more, commonest first. Columns
    come in the order given; the first ``REVIEWED`` rare values are the review.
    """
    one = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), cells.trim(col(c)).alias("value")) for i, c in enumerate(names))))
    rows = df.select(F.col(ROW), one.alias("x")).select("x.*", ROW).filter("value != ''")
    counts = rows.groupBy("i", "column", "value").agg(F.count("*").alias("n"), F.min(ROW).alias("first"))
    per = W.partitionBy("column")
    best = counts.withColumn("k", F.row_number().over(per.orderBy(F.desc("n"), "first"))).filter(F.col("k") <= REVIEWED)
    best = best.groupBy("column").agg(F.count("*").alias("values"), F.max("n").alias("peak"), F.transform(F.sort_array(F.collect_list(F.when(F.col("n") >= top, F.struct("k", "value")))), lambda t: t["value"]).alias("targets"))
    kept = best.filter((F.col("values") >= 3) & (F.col("peak") >= top)).select("column", "targets")  # a row for each column
    return counts.filter(F.col("n") <= most).join(F.broadcast(kept), "column").orderBy("i", F.desc("n"), "first").limit(REVIEWED).select("column", "value", "n", "targets")


#: Most different values of a column that is browsed by its values.
CATEGORIES = 25
_BROWSED_STRINGS = 0.9


def category_columns(p: Profile) -> list[ColumnProfile]:
    """Columns that read as categories, fewest values first: typed so, or texts that repeat, or numbers of few values."""
    repeats = lambda c: c.unique <= CATEGORIES and c.unique < _BROWSED_STRINGS * c.filled
    like = lambda c: c.type in ("category", "boolean") or (c.type == "string" and repeats(c)) or (c.type == "number" and c.unique <= CATEGORIES)
    return sorted((c for c in p.columns if c.unique and like(c)), key=lambda c: c.unique)


def natural_key(c: Column) -> Column:
    """An order in which 2 comes before 10: numbers are padded."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def browse(df: DataFrame, name: str, text: str = "", by: str = "count") -> DataFrame:
    """name, value of one column's values that contain ``text``, whatever the case, by count or by natural name."""
    found = first_values(df, name).filter(F.contains(F.lower("name"), F.lit(text.lower())))
    return found.orderBy(*([F.desc("value"), F.col("first")] if by == "count" else [natural_key(F.col("name")), F.col("name")])).select("name", "value")


def page(df: DataFrame, number: int, size: int = 15) -> DataFrame:
    """One page of rows in order, from page 0 on; for far pages of large tables see :class:`siltstone.operators.pages.Pages`."""
    return df.orderBy(ROW).offset(number * size).limit(size)


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows with a cell that contains the text, without regard to case."""
    hit = F.lit(False)
    for c in (c for c in df.columns if c != ROW):
        hit = hit | F.coalesce(F.contains(F.lower(cells.text_of(col(c))), F.lit(text.lower())), F.lit(False))
    return df.filter(hit)
