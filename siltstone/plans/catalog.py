"""Registered queries of the engine, each over whole tables, and the SQL that checks each of them.

The tables are clean, so queries about blanks, spellings and formats make their
mess by expressions that both sides write out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators import aggregates as agg
from siltstone.operators import charts, clean, issues, joins, kpi, missing, outliers, periods
from siltstone.operators import profile as prof
from siltstone.operators import query as q
from siltstone.operators.pivot import OTHER, TOTAL, Pivot, drill, pivot
from siltstone.plans import workflow
from siltstone.plans.recipe import Dataset
from siltstone.sources import text_tables
from siltstone.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SECOND = "yyyy-MM-dd HH:mm:ss"


def _money(c) -> F.Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(F.round(c, 2).cast("decimal(18,2)")).cast("double")


# ---- filters, groups, orders


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and money by return flag of larger items, most money first."""
    df = _t(spark, sf_dir, "lineitem").filter(q.compare(F.col("l_quantity"), ">", 10, "double"))
    out = df.groupBy("l_returnflag").agg(q.aggregate("count", None).alias("n"), _money(F.col("l_extendedprice")).alias("total"))
    return q.ordered(out, ("total", False), tie=["l_returnflag"]).limit(3)


QUERIES["sql_minimum_slice"] = flagship
SQL["sql_minimum_slice"] = "SELECT l_returnflag, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem WHERE l_quantity > 10 GROUP BY 1 ORDER BY total DESC LIMIT 3"


@registered("SELECT l_orderkey, l_linenumber, l_quantity AS qty FROM lineitem WHERE (l_quantity > 45 AND l_returnflag = 'R') OR l_discount = 0")
def sql_filter_project(spark, sf_dir):
    c = F.col
    df = _t(spark, sf_dir, "lineitem")
    return df.filter(q.any_of([q.compare(c("l_quantity"), ">", 45, "double"), q.compare(c("l_returnflag"), "=", "r")], [q.compare(c("l_discount"), "=", 0, "double")])).select("l_orderkey", "l_linenumber", c("l_quantity").alias("qty"))


@registered("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'r%g_t'")
def sql_like_ci(spark, sf_dir):
    return _t(spark, sf_dir, "part").filter(q.like(F.col("p_name"), "R%G_T")).select("p_partkey", "p_name")


@registered("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS n_tax, sum(l_quantity)::DOUBLE AS qty, round(avg(l_discount), 6) AS disc, min(l_extendedprice) AS low, max(l_extendedprice) AS high
FROM lineitem GROUP BY 1, 2""")
def sql_group_agg(spark, sf_dir):
    c = F.col
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        q.aggregate("count", None).alias("n"), q.aggregate("count", c("l_tax")).alias("n_tax"), q.aggregate("sum", c("l_quantity"), "double").alias("qty"), F.round(q.aggregate("avg", c("l_discount"), "double"), 6).alias("disc"), q.aggregate("min", c("l_extendedprice"), "double").alias("low"), q.aggregate("max", c("l_extendedprice"), "double").alias("high")
    )


@registered("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey < 0")
def sql_global_agg_empty(spark, sf_dir):
    return _t(spark, sf_dir, "orders").filter(q.compare(F.col("o_orderkey"), "<", 0, "bigint")).agg(q.aggregate("count", None).alias("n"), q.aggregate("sum", F.col("o_totalprice"), "double").alias("total"))


@registered("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def sql_count_distinct(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(q.aggregate("count", F.col("o_custkey"), distinct=True).alias("customers"))


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def sql_order_limit(spark, sf_dir):
    return q.ordered(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", False), tie=["o_orderkey"]).limit(20)


@registered("SELECT o_orderpriority, arg_min(o_custkey, o_orderkey) AS first_customer FROM orders GROUP BY 1")
def sql_first_in_group(spark, sf_dir):
    return q.with_rows(_t(spark, sf_dir, "orders"), "o_orderkey").groupBy("o_orderpriority").agg(q.first_value("o_custkey").alias("first_customer"))


@registered("""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '  ' ELSE o_orderpriority END AS p FROM orders)
SELECT count(*) FILTER (p IS NULL) AS nulls, count(p) AS counted, count(*) FILTER (coalesce(lower(p), '') <> '1-urgent') AS unequal, count(*) FILTER (coalesce(lower(p), '') < '5') AS below FROM m""")
def null_blank_semantics(spark, sf_dir):
    o = F.col("o_orderkey")
    p = F.when(o % 7 == 0, F.lit(None)).when(o % 7 == 1, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    m = _t(spark, sf_dir, "orders").select(p.alias("p"))
    c = F.col("p")
    return m.agg(F.count_if(c.isNull()).alias("nulls"), F.count(c).alias("counted"), F.count_if(q.compare(c, "!=", "1-URGENT")).alias("unequal"), F.count_if(q.compare(c, "<", "5")).alias("below"))


@registered("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
def sql_native_mode(spark, sf_dir):
    return q.read_only(spark, "SELECT o_orderstatus, count(*) AS n FROM siltstone_orders GROUP BY 1 ORDER BY 2 DESC, 1", siltstone_orders=_t(spark, sf_dir, "orders"))


# ---- cell policies


@registered("""WITH m AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS v FROM lineitem)
SELECT count(*) AS n, sum(v::DECIMAL(18,2))::DOUBLE AS total FROM m""")
def parse_numeric_currency(spark, sf_dir):
    text = F.format_number(F.col("l_extendedprice"), 2)
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("($"), text, F.lit(")"))).otherwise(F.concat(F.lit(" € "), text, F.lit(" ")))
    n = cells.number(shown)
    return _t(spark, sf_dir, "lineitem").select(n.alias("v")).agg(F.count("v").alias("n"), _money(F.col("v")).alias("total"))


@registered("""SELECT replace(o_orderpriority, '-', ' -') AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1""")
def clean_trim(spark, sf_dir):
    text = F.concat(F.lit(" \u00a0 "), F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit(" \u00a0-")), F.lit("\t\ufeff"))
    return _t(spark, sf_dir, "orders").groupBy(cells.squeeze(text).alias("o_orderpriority")).agg(F.count("*").alias("n"))


@registered("SELECT c_custkey, 'Customer-' || lpad(c_custkey::VARCHAR, 6, '0') || ' Of The (North' AS name FROM customer")
def clean_title(spark, sf_dir):
    made = F.concat(F.lit("CUSTOMER-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(" OF THE (NORTH"))
    return _t(spark, sf_dir, "customer").select("c_custkey", made.alias("name")).select("c_custkey", cells.standard_case(F.col("name")).alias("name"))


@registered("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS p_1, nullif(trim(split_part(o_orderpriority, '-', 2)), '') AS p_2 FROM orders")
def clean_split(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"))
    out = clean.apply(q.with_rows(df, "o_orderkey"), ("splitColumn", "p", "-"))
    return out.select("o_orderkey", "p_1", "p_2")


@registered("SELECT c_custkey, replace(c_mktsegment, 'BUILD', '$1') AS c_mktsegment FROM customer")
def clean_find_replace(spark, sf_dir):
    df = q.with_rows(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return clean.apply(df, ("findReplace", "c_mktsegment", "build", "$1")).select("c_custkey", "c_mktsegment")


@registered("SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSE' WHEN 'MACHINERY' THEN 'TOOLS' ELSE c_mktsegment END AS segment, count(*) AS n FROM customer GROUP BY 1")
def clean_merge(spark, sf_dir):
    df = q.with_rows(_t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("segment")), "c_custkey")
    merged = clean.apply(df, ("mergeValues", "segment", {"BUILDING": "HOUSE", "MACHINERY": "TOOLS"}))
    return clean.apply(merged, ("trimWhitespace",)).groupBy("segment").agg(F.count("*").alias("n"))


@registered("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def clean_excel_dates(spark, sf_dir):
    serial = F.datediff(F.col("o_orderdate"), F.lit("1899-12-30")).cast("string")
    df = q.with_rows(_t(spark, sf_dir, "orders").select("o_orderkey", serial.alias("day")), "o_orderkey")
    return clean.apply(df, ("convertExcelDates", "day")).select("o_orderkey", "day")


@registered("SELECT count(*) AS n, sum(CASE WHEN l_linenumber = 2 THEN (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem WHERE l_linenumber <> 2) ELSE l_quantity END)::DOUBLE AS total FROM lineitem")
def clean_fill_median(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("v"))
    return clean.apply(q.with_rows(df), ("fillMissing", "v", "median")).agg(F.count("v").alias("n"), F.sum("v").alias("total"))


@registered("""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders),
top AS (SELECT p FROM m WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)
SELECT coalesce(p, (SELECT p FROM top)) AS p, count(*) AS n FROM m GROUP BY 1""")
def clean_fill_mode(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p"))
    return clean.apply(q.with_rows(df, "o_orderkey"), ("fillMissing", "p", "mode")).groupBy("p").agg(F.count("*").alias("n"))


_FENCES = "f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), l AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM f)"


@registered(f"WITH {_FENCES} SELECT event_id, greatest(lo, least(hi, value)) AS value FROM events, l")
def clean_cap_outliers(spark, sf_dir):
    df = q.with_rows(_t(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    return clean.apply(df, ("capOutliers", "value")).select("event_id", "value")


@registered(f"WITH {_FENCES} SELECT count(*) AS n, max(value) AS high FROM events, l WHERE value BETWEEN lo AND hi")
def clean_drop_outliers(spark, sf_dir):
    df = q.with_rows(_t(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    return clean.apply(df, ("dropOutlierRows", "value")).agg(F.count("*").alias("n"), F.max("value").alias("high"))


@registered("SELECT count(*) AS n FROM lineitem")
def clean_drop_duplicates(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    twice = df.unionByName(df.filter(F.col("l_orderkey") % 4 == 0))
    return clean.apply(q.with_rows(twice), ("dropDuplicates",)).agg(F.count("*").alias("n"))


@registered("SELECT count(*) AS n FROM supplier WHERE s_suppkey % 3 <> 0")
def clean_drop_empty_rows(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    hide = F.col("s_suppkey") % 3 == 0
    df = s.select(*(F.when(~hide, F.col(c).cast("string")).otherwise(F.lit(" ")).alias(c) for c in s.columns))
    return clean.apply(q.with_rows(df), ("dropEmptyRows",)).agg(F.count("*").alias("n"))


@registered("SELECT p_partkey, 'café – ' || p_name AS p_name FROM part")
def clean_fix_encoding(spark, sf_dir):
    made = F.concat(F.lit("cafÃ© â€“ "), F.col("p_name"))
    df = q.with_rows(_t(spark, sf_dir, "part").select("p_partkey", made.alias("p_name")), "p_partkey")
    return clean.apply(df, ("fixEncoding",)).select("p_partkey", "p_name")


# ---- joins

_JOIN = """WITH c AS (SELECT ' ' || upper(c_name) || CASE WHEN c_custkey % 3 = 0 THEN '!' ELSE '' END AS k, c_nationkey AS v, c_acctbal FROM customer UNION ALL SELECT NULL, 1, 0.0 UNION ALL SELECT '  ', 2, 0.0),
o AS (SELECT lower(c_name) || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '?' END AS name, o_orderkey AS v, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'nobody', 0, 1.0 UNION ALL SELECT NULL, 1, 2.0)
SELECT {} AS k, c.v::DOUBLE AS v_left, c_acctbal, o.v::DOUBLE AS v_right, o_totalprice FROM c {} JOIN o ON nullif(lower(trim(k)), '') = nullif(lower(trim(name)), '')"""


def _join(how: str):
    def run(spark, sf_dir):
        c = _t(spark, sf_dir, "customer")
        left = c.select(F.concat(F.lit(" "), F.upper("c_name"), F.when(F.col("c_custkey") % 3 == 0, "!").otherwise("")).alias("k"), F.col("c_nationkey").alias("v"), "c_acctbal")
        left = left.unionByName(spark.createDataFrame([(None, 1, 0.0), ("  ", 2, 0.0)], "k string, v int, c_acctbal double"))
        right = _t(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lower("c_name"), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("?")).alias("name"), F.col("o_orderkey").alias("v"), "o_totalprice")
        right = right.unionByName(spark.createDataFrame([("nobody", 0, 1.0), (None, 1, 2.0)], "name string, v long, o_totalprice double"))
        return joins.join(left, right, "k", "name", how).withColumns({c: F.col(c).cast("double") for c in ("v_left", "v_right")})

    return run


for _how, _key in (("inner", "k"), ("left", "k"), ("right", "CASE WHEN c.c_acctbal IS NULL THEN name ELSE k END"), ("full", "CASE WHEN c.c_acctbal IS NULL THEN name ELSE k END")):
    QUERIES[f"join_{_how}"] = _join(_how)
    SQL[f"join_{_how}"] = _JOIN.format(_key, _how)


# ---- aggregates and series


@registered("SELECT o_orderpriority AS name, count(*) AS value FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return agg.value_counts(_t(spark, sf_dir, "orders"), "o_orderpriority")


@registered("SELECT p_brand AS name, round(sum(p_retailprice), 4) AS value FROM part GROUP BY 1")
def sum_by(spark, sf_dir):
    return agg.sum_by(_t(spark, sf_dir, "part"), "p_brand", "p_retailprice").withColumn("value", F.round("value", 4))


@registered("""WITH c AS (SELECT p_type AS name, count(*) AS value FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS k FROM c)
SELECT name, value FROM r WHERE k <= 3 UNION ALL SELECT 'Other', sum(value)::BIGINT FROM r WHERE k > 3 HAVING count(*) > 0""")
def top_with_other(spark, sf_dir):
    return agg.top_with_other(agg.value_counts(_t(spark, sf_dir, "part"), "p_type"), 3)


@registered("SELECT o_orderpriority AS name, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def agg_by_avg(spark, sf_dir):
    return agg.aggregate_by(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "avg")


@registered("""WITH m AS (SELECT min(value) AS a, max(value) AS b, (max(value) - min(value)) / 10 AS w FROM events), c AS (SELECT least(9, floor((value - a) / w))::INT AS bin, count(*) AS n FROM events, m GROUP BY 1)
SELECT i::INT AS bin, a + i * w AS low, a + (i + 1) * w AS high, coalesce(n, 0)::BIGINT AS n FROM m, range(10) t(i) LEFT JOIN c ON c.bin = i""")
def histogram(spark, sf_dir):
    return agg.histogram(_t(spark, sf_dir, "events"), "value")


@registered("SELECT strftime(o_orderdate, '%Y-%m') AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1")
def bucket_month(spark, sf_dir):
    return agg.bucket_by_date(_t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").withColumn("value", F.round("value", 2))


@registered("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*)::DOUBLE AS value FROM events GROUP BY 1")
def bucket_day(spark, sf_dir):
    return agg.bucket_by_date(_t(spark, sf_dir, "events"), "ts")


@registered("SELECT strftime(o_orderdate, '%Y-%m') AS date, max(o_totalprice) AS value FROM orders GROUP BY 1")
def bucket_month_max(spark, sf_dir):
    return agg.bucket_by_date(_t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "max")


@registered("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6), count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6), count(*) FROM lineitem""")
def pearson(spark, sf_dir):
    return agg.correlations(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).withColumn("r", F.round("r", 6))


@registered("""WITH r AS (SELECT DISTINCT l_returnflag AS r FROM lineitem), c AS (SELECT DISTINCT l_linestatus AS c FROM lineitem), v AS (SELECT l_returnflag AS r, l_linestatus AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT r.r, c.c, coalesce(v, 0)::DOUBLE AS value FROM r CROSS JOIN c LEFT JOIN v ON v.r = r.r AND v.c = c.c""")
def heatmap(spark, sf_dir):
    return agg.cross_tab(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")


@registered("SELECT o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders ORDER BY o_orderkey LIMIT 2000")
def scatter(spark, sf_dir):
    df = q.with_rows(_t(spark, sf_dir, "orders"), "o_orderkey")
    return charts.series(df, prof.Profile(0, [], 0, False), charts.Chart("scatter", "o_totalprice", "o_custkey"))


@registered("SELECT p_partkey FROM part WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR p_type ILIKE '%an%' OR p_size::VARCHAR LIKE '%an%'")
def grid_search(spark, sf_dir):
    return agg.search(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "AN").select("p_partkey")


@registered("""WITH m AS (SELECT CASE WHEN o_orderkey <= 64 THEN 'Order ' || (o_orderkey // 2) ELSE o_orderpriority END AS p FROM orders), c AS (SELECT p AS name, count(*) AS value FROM m GROUP BY 1) SELECT name, value FROM c WHERE value <= 2 AND (SELECT max(value) FROM c) >= 3""")
def rare_values(spark, sf_dir):
    o = F.col("o_orderkey")
    p = F.when(o <= 64, F.concat(F.lit("Order "), F.floor(o / 2))).otherwise(F.col("o_orderpriority"))
    return agg.rare_values(_t(spark, sf_dir, "orders").select(p.alias("p")), "p")


# ---- pivots

_ROWS = "WITH s AS (SELECT c_mktsegment AS r, o_orderstatus AS c, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey) "


def _sales(spark, sf_dir):
    return _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def _paths(df: DataFrame) -> DataFrame:
    return df.drop("is_other").withColumns({"row_path": F.array_join("row_path", "/"), "col_path": F.array_join("col_path", "/")})


@registered(_ROWS + "SELECT r AS row_path, c AS col_path, sum(v::DECIMAL(18,2))::DOUBLE AS v0, count(*)::DOUBLE AS v1 FROM s GROUP BY GROUPING SETS ((r, c), (r), (c), ())")
def pivot_totals(spark, sf_dir):
    return _paths(pivot(_sales(spark, sf_dir), Pivot(("c_mktsegment",), ("o_orderstatus",), (("o_totalprice", "sum"), (None, "count"))))).withColumn("v0", F.round("v0", 2))


@registered(_ROWS + "SELECT r AS row_path, c AS col_path, round(avg(v), 4) AS v0 FROM s GROUP BY GROUPING SETS ((r, c), (r), (c), ())")
def pivot_avg(spark, sf_dir):
    return _paths(pivot(_sales(spark, sf_dir), Pivot(("c_mktsegment",), ("o_orderstatus",), (("o_totalprice", "avg"),)))).withColumn("v0", F.round("v0", 4))


@registered(_ROWS + "SELECT r AS row_path, c AS col_path, max(v) AS v0, min(v) AS v1 FROM s WHERE c IN ('F', 'O') GROUP BY GROUPING SETS ((r, c), (r), (c), ())")
def pivot_filtered(spark, sf_dir):
    return _paths(pivot(_sales(spark, sf_dir), Pivot(("c_mktsegment",), ("o_orderstatus",), (("o_totalprice", "max"), ("o_totalprice", "min")), (("o_orderstatus", ("F", "O")), ("c_mktsegment", ())))))


@registered(_ROWS + f""", t AS (SELECT r, row_number() OVER (ORDER BY sum(v) DESC, r) AS k FROM s GROUP BY r), x AS (SELECT CASE WHEN k <= 2 THEN r ELSE '{OTHER}' END AS r, '{TOTAL}' AS c, v FROM s JOIN t USING (r))
SELECT r AS row_path, c AS col_path, sum(v::DECIMAL(18,2))::DOUBLE AS v0 FROM x GROUP BY GROUPING SETS ((r, c), (r), (c), ())""")
def pivot_other(spark, sf_dir):
    return _paths(pivot(_sales(spark, sf_dir), Pivot(("c_mktsegment",), (), (("o_totalprice", "sum"),), limit=2))).withColumn("v0", F.round("v0", 2))


@registered("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def pivot_drill(spark, sf_dir):
    return drill(_sales(spark, sf_dir), Pivot(("c_mktsegment",), ("o_orderstatus",)), ["BUILDING"], ["F"]).select("o_orderkey")


# ---- profiles


@registered(f"""WITH {_FENCES} SELECT count(*) AS n, count(DISTINCT value) AS uniq, count(*) FILTER (value < lo OR value > hi) AS outliers, round(min(value), 2) AS low, round(max(value), 2) AS high, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS sd,
printf('%.2f', quantile_cont(value, 0.25))::DOUBLE AS p25, printf('%.2f', quantile_cont(value, 0.5))::DOUBLE AS p50, printf('%.2f', quantile_cont(value, 0.75))::DOUBLE AS p75 FROM events, l""")
def profile_numeric(spark, sf_dir):
    p, _ = _table_profile(spark, sf_dir, "events", "event_id")
    x = p["value"]
    return spark.createDataFrame([(x.filled, x.unique, x.outliers, x.min, x.max, x.mean, x.std, x.p25, x.median, x.p75)], "n long, uniq long, outliers long, low double, high double, mean double, sd double, p25 double, p50 double, p75 double")


@registered("""SELECT name, value FROM (SELECT p_name AS name, count(*) AS value, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS k FROM part GROUP BY 1) WHERE k <= 5""")
def profile_topvalues(spark, sf_dir):
    p, _ = _table_profile(spark, sf_dir, "part", "p_partkey")
    return spark.createDataFrame(p["p_name"].top, "name string, value long")


@registered("SELECT count(*) AS n FROM lineitem WHERE l_orderkey % 4 = 0")
def duplicate_rows(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(prof.duplicate_rows(df.unionByName(df.filter("l_orderkey % 4 = 0"))),)], "n long")


def _table_profile(spark, sf_dir, name, *order):
    df = q.with_rows(_t(spark, sf_dir, name), *order)
    return prof.profile(df), df


@registered("""SELECT 'c_custkey' AS "column", 'string' AS type, count(*) AS rows, count(DISTINCT c_custkey) AS uniq FROM customer UNION ALL SELECT 'c_name', 'string', count(*), count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'c_nationkey', 'number', count(*), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', 'number', count(*), count(DISTINCT c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) < 0.15 * count(*) THEN 'category' ELSE 'string' END, count(*), count(DISTINCT c_mktsegment) FROM customer""".replace("'c_custkey' AS \"column\", 'string'", "'c_custkey' AS \"column\", 'number'"))
def profile_table(spark, sf_dir):
    p, _ = _table_profile(spark, sf_dir, "customer", "c_custkey")
    return prof.profile_table(p, spark).select("column", "type", "rows", F.col("unique").alias("uniq"))


@registered(f"""WITH {_FENCES} SELECT 'index:event_id' AS id, 'index' AS rule, 'info' AS severity, 'event_id only numbers the rows' AS message
UNION ALL SELECT 'repeatedId:user_id', 'repeatedId', 'warning', (count(user_id) - count(DISTINCT user_id)) || ' repeated values in user_id' FROM events
UNION ALL SELECT 'outliers:value', 'outliers', 'info', count(*) || ' values of value outside its fences' FROM events, l WHERE value < lo OR value > hi""")
def profile_diagnostics(spark, sf_dir):
    p, _ = _table_profile(spark, sf_dir, "events", "event_id")
    return spark.createDataFrame([(d.id, d.rule, d.severity, d.message) for d in p.diagnostics], "id string, rule string, severity string, message string")


@registered("""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN '  ' || o_orderpriority ELSE o_orderpriority END AS p FROM orders)
SELECT (o_orderkey)::BIGINT AS "row", 'p' AS "column", CASE WHEN p IS NULL THEN 'missing' ELSE 'whitespace' END AS rule, trim(p) AS proposed FROM m WHERE p IS NULL OR p <> trim(p)""")
def cell_issues(spark, sf_dir):
    o = F.col("o_orderkey")
    p = F.when(o % 11 == 0, F.lit(None)).when(o % 11 == 1, F.concat(F.lit("  "), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    df = _t(spark, sf_dir, "orders").select(p.alias("p"), o.alias(q.ROW))
    found = prof.Profile(0, [prof.ColumnProfile("p", "string", "category")], 0, False)
    return issues.cell_issues(df, found).filter("rule <> 'duplicates'").select("row", "column", "rule", "proposed")


# ---- key figures, outliers, missing values, periods


@registered("""WITH w AS (SELECT max(o_orderdate) AS m FROM orders), f AS (SELECT o.*, o_orderdate > m - INTERVAL 365 DAY AS cur, o_orderdate > m - INTERVAL 730 DAY AND o_orderdate <= m - INTERVAL 365 DAY AS prev FROM orders o, w)
SELECT 'Total O Totalprice' AS label, round(sum(o_totalprice) FILTER (cur), 2) AS value, round(sum(o_totalprice) FILTER (prev), 2) AS previous FROM f
UNION ALL SELECT 'Average Order Value', round(avg(o_totalprice) FILTER (cur), 2), round(avg(o_totalprice) FILTER (prev), 2) FROM f""")
def kpi_windows(spark, sf_dir):
    df = q.with_rows(_t(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice"))
    p = prof.profile(df)
    rows = [(k.label, round(k.value, 2), round(k.previous, 2)) for k in kpi.kpis(df, p) if k.id in ("revenue", "aov")]
    return spark.createDataFrame(rows, "label string, value double, previous double")


@registered(f"WITH {_FENCES} SELECT event_type AS segment, count(*) AS n, count(*) FILTER (value < lo OR value > hi) AS outliers FROM events, l GROUP BY 1 HAVING count(*) >= 5")
def outlier_segments(spark, sf_dir):
    df = q.with_rows(_t(spark, sf_dir, "events"), "event_id")
    low, high, _ = outliers.limits(df, "value")
    return outliers.segments(df, "value", ["event_type"], low, high).select("segment", "n", "outliers")


@registered(f"WITH {_FENCES} SELECT 'user_id' AS \"column\", round(avg(user_id) FILTER (value < lo OR value > hi), 6) AS outlier_mean, round(avg(user_id) FILTER (value BETWEEN lo AND hi), 6) AS normal_mean FROM events, l")
def outlier_contrasts(spark, sf_dir):
    df = q.with_rows(_t(spark, sf_dir, "events"), "event_id")
    low, high, _ = outliers.limits(df, "value")
    return outliers.contrasts(df, "value", ["user_id"], low, high).select("column", F.round("outlier_mean", 6).alias("outlier_mean"), F.round("normal_mean", 6).alias("normal_mean"))


@registered(f"WITH {_FENCES} SELECT event_id AS \"row\", value FROM events, l WHERE value < lo OR value > hi ORDER BY CASE WHEN value < lo THEN lo - value ELSE value - hi END DESC, event_id LIMIT 50")
def outlier_records(spark, sf_dir):
    df = q.with_rows(_t(spark, sf_dir, "events"), "event_id")
    return outliers.records(df, "value", *outliers.limits(df, "value")).select("row", "value")


_GAPS = "WITH m AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 0 OR o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)"


@registered(f"""{_GAPS}, t AS (SELECT o_orderpriority AS s, count(*) AS n, count(*) FILTER (v IS NULL) AS m FROM m GROUP BY 1 HAVING count(*) >= 15),
e AS (SELECT *, n * sum(m) OVER () / sum(n) OVER () AS em, n * (sum(n) OVER () - sum(m) OVER ()) / sum(n) OVER () AS ep FROM t)
SELECT 'o_orderpriority' AS "column", sum(n)::BIGINT AS n, count(*) AS segments, round(sum((m - em) ** 2 / em + (n - m - ep) ** 2 / ep), 4) AS chi2 FROM e""")
def missing_assoc(spark, sf_dir):
    v = F.when(~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 3 != 0) | (F.col("o_orderkey") % 13 == 0)), F.col("o_totalprice"))
    df = _t(spark, sf_dir, "orders").withColumn("v", v)
    return missing.chi_squared(missing.two_way(df, "v", ["o_orderpriority"])).withColumn("chi2", F.round("chi2", 4))


@registered("""WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (o_orderdate >= TIMESTAMP '1999-01-01') AS m FROM orders GROUP BY 1),
c AS (SELECT day, sum(n) OVER w AS n0, sum(m) OVER w AS m0, sum(n) OVER () AS an, sum(m) OVER () AS am FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT day, round(m0 / n0 * 100, 6) AS before, round((am - m0) / (an - n0) * 100, 6) AS after FROM c WHERE n0 >= 15 AND an - n0 >= 15""")
def missing_onset(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp"), F.col("o_totalprice")))
    return missing.onset(df, "v", "o_orderdate").select("day", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


_YEARS = "WITH a AS (SELECT * FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT * FROM orders WHERE year(o_orderdate) = 1997)"


@registered(f"{_YEARS} SELECT 'o_totalprice' AS \"column\", round((SELECT sum(o_totalprice) FROM a), 2) AS total_before, round((SELECT sum(o_totalprice) FROM b), 2) AS total_after, round((SELECT avg(o_totalprice) FROM a), 4) AS mean_before, round((SELECT avg(o_totalprice) FROM b), 4) AS mean_after")
def period_diff_numeric(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    x = periods.numeric_changes(o.filter("year(o_orderdate) = 1996"), o.filter("year(o_orderdate) = 1997"), ["o_totalprice"])
    return x.select("column", *(F.round(c, 2 if c.startswith("total") else 4).alias(c) for c in ("total_before", "total_after", "mean_before", "mean_after")))


@registered("""WITH a AS (SELECT DISTINCT o_custkey::VARCHAR AS v FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey::VARCHAR AS v FROM orders WHERE year(o_orderdate) = 1997)
SELECT v AS value, 'appeared' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT v, 'disappeared' FROM (FROM a EXCEPT FROM b)""")
def period_diff_category(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return periods.value_changes(o.filter("year(o_orderdate) = 1996"), o.filter("year(o_orderdate) = 1997"), "o_custkey")


@registered("SELECT p_type AS name, count(*)::DOUBLE AS value FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') GROUP BY 1")
def dashboard_filter(spark, sf_dir):
    df = charts.apply_filters(_t(spark, sf_dir, "part"), {"p_brand": ["Brand#11", "Brand#12"], "p_type": []})
    return agg.aggregate_by(df, "p_type", None, "count")


@registered("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS d, o_totalprice AS v, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT d, sum(v) AS v, row_number() OVER (ORDER BY d) AS i FROM o GROUP BY d), e AS (SELECT (arg_max(v, d) - arg_min(v, d)) / arg_min(v, d) * 100 AS x, regr_r2(v, i) AS r2 FROM s),
st AS (SELECT d, i, v - lag(v) OVER (ORDER BY d) AS x FROM s QUALIFY x IS NOT NULL), md AS (SELECT median(x) AS m FROM st), sc AS (SELECT median(abs(x - m)) AS w FROM st, md),
ra AS (SELECT d, x, abs(x - m) / w AS r, lag(x) OVER (ORDER BY d) AS px, lag(d) OVER (ORDER BY d) AS pd, lag(abs(x - m) / w) OVER (ORDER BY d) AS pr FROM st, md, sc),
top AS (SELECT *, px * x < 0 AND abs(px) >= 0.6 * abs(x) AS back FROM ra ORDER BY r DESC, d LIMIT 1), ch AS (SELECT CASE WHEN back THEN pd ELSE d END AS d, CASE WHEN back THEN px ELSE x END AS x, CASE WHEN back THEN pr ELSE r END AS r FROM top WHERE r >= 3),
g AS (SELECT seg, sum(v) AS v, count(*) AS n FROM o GROUP BY seg), t AS (SELECT sum(v) AS total, count(*) AS k, max(v) AS best, min(v) AS least FROM g), y AS (SELECT max(v / n) AS hi, min(v / n) AS lo FROM g WHERE n >= 5),
b AS (SELECT seg, d, sum(v) AS v FROM o GROUP BY seg, d), gr AS (SELECT seg, (arg_max(v, d) - arg_min(v, d)) / abs(arg_min(v, d)) * 100 AS x FROM b GROUP BY seg HAVING count(*) >= 3),
q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS z FROM o), ou AS (SELECT count(*) FILTER (v < a - 1.5 * (z - a) OR v > z + 1.5 * (z - a)) AS n, count(*) AS rows FROM o, q)
SELECT 'trend_o_totalprice' AS id, 'trend' AS kind, CASE WHEN x > 0 THEN 'positive' ELSE 'warning' END AS severity, round(70 + least(40, abs(x) / 4) + CASE WHEN r2 >= 0.5 THEN 8 ELSE 0 END, 3) AS score FROM e WHERE abs(x) >= 10
UNION ALL SELECT 'change_o_totalprice_' || d, 'change', CASE WHEN x > 0 THEN 'info' ELSE 'critical' END, round(60 + least(25, 4 * r) + CASE WHEN x > 0 THEN 0 ELSE 6 END, 3) FROM ch
UNION ALL SELECT 'outlier_o_totalprice', 'outlier', CASE WHEN 100.0 * n / rows >= 5 THEN 'warning' ELSE 'info' END, round(45 + least(25, 300.0 * n / rows), 3) FROM ou WHERE n > 0
UNION ALL SELECT 'perf_top_c_mktsegment', 'performance', 'positive', round(58 + least(20, 40 * best / total), 3) FROM t
UNION ALL SELECT 'perf_bottom_c_mktsegment', 'performance', 'warning', round(56 + least(18, 20 * (total / k - least) / (total / k)), 3) FROM t WHERE least < total / k / 2
UNION ALL SELECT 'risk_concentration_c_mktsegment', 'risk', CASE WHEN 100 * best / total >= 60 THEN 'critical' ELSE 'warning' END, round(66 + least(20, (100 * best / total - 40) / 2), 3) FROM t WHERE 100 * best / total >= 40
UNION ALL SELECT 'opp_growth_c_mktsegment', 'opportunity', 'positive', round(60 + least(20, max(x) / 5), 3) FROM gr HAVING count(*) >= 2 AND max(x) >= 15
UNION ALL SELECT 'opp_yield_c_mktsegment', 'opportunity', 'info', 54.0 FROM y WHERE lo < 0.6 * hi""")
def insight_findings(spark, sf_dir):
    from siltstone.operators import insights

    df = q.with_rows(_sales(spark, sf_dir).select("o_orderkey", "o_orderdate", "o_totalprice", "c_mktsegment", "o_orderpriority"), "o_orderkey")
    p = prof.profile(df)
    found = insights.analyze(insights.Context(df, p, kpi.read(p, df)))
    return spark.createDataFrame([(f.id, f.kind, f.severity, round(float(f.score), 3)) for f in found], "id string, kind string, severity string, score double")


@registered("SELECT count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders")
def recipe_replay(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    messy = o.select("o_orderkey", F.concat(F.lit(" $"), F.format_number("o_totalprice", 2)).alias("price"), F.concat(F.col("o_orderpriority"), F.lit("  ")).alias("priority"))
    ds = Dataset.of("orders", messy.unionByName(messy.filter("o_orderkey % 10 = 0"))).apply(("trimWhitespace",), ("dropDuplicates",), ("findReplace", "price", "$", ""), ("dropColumn", "gone"))
    return ds.df.agg(F.count("*").alias("n"), _money(cells.number(F.col("price"))).alias("total"))


@registered("""SELECT o_orderkey AS "row", 'p' AS "column", ' ' || o_orderpriority AS before, o_orderpriority AS after FROM orders WHERE o_orderkey % 9 = 0""")
def recipe_preview(spark, sf_dir):
    p = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit(" "), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    df = _t(spark, sf_dir, "orders").select(p.alias("p"), F.col("o_orderkey").alias(q.ROW))
    return clean.changes(df, ("trimWhitespace",))[0]


@registered()
def text_table_rows(spark, sf_dir):
    rows = text_tables.table_rows(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id", "table").agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("width"))


@registered("SELECT o_custkey, max(o_orderdate)::DATE::VARCHAR AS day, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def recipe_book_newest(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return workflow.newest(rows, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")


@registered("""WITH s AS (SELECT DISTINCT p_name AS label, CASE WHEN p_name = 'red ring' THEN 1000 WHEN starts_with(p_name, 'red ring') THEN 800 WHEN regexp_matches(p_name, '\\bred ring') THEN 600 WHEN contains(p_name, 'red ring') THEN 400 WHEN regexp_matches(p_name, 'r.*e.*d.*r.*i.*n.*g') THEN 100 END AS score FROM part)
SELECT label, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, length(label), label LIMIT 20""")
def workspace_search(spark, sf_dir):
    return workflow.search(_t(spark, sf_dir, "part"), "p_name", "Red Ring")


# ---- event streams, run here over the whole table


@registered("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return windows.tumbling(_t(spark, sf_dir, "events")).withColumns({"total": F.round("total", 4), "start": F.date_format("start", _SECOND)})


@registered("""WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    return windows.sessions(_t(spark, sf_dir, "events")).withColumns({c: F.date_format(c, _SECOND) for c in ("start", "stop")})


from siltstone.plans import catalog_more, catalog_tables  # noqa: E402, F401  register their queries here
