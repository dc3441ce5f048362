"""Registered queries of workbooks, nested values, stored sketches, whole-row sets, pages, bundles, spellings and models, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import charts, insights, kpi, nested, pages, sets, sketches, spellings
from siltstone.operators import pivot as piv
from siltstone.operators import profile as prof
from siltstone.operators import query as q
from siltstone.plans import bundle, model
from siltstone.plans.catalog import _GAPS, _sales, _t, registered
from siltstone.plans.recipe import Dataset
from siltstone.sources import files, scratch, workbooks
from siltstone.streaming import stateful

# ---- workbooks


@registered("""SELECT o_orderkey::DOUBLE AS "Order", o_orderstatus AS Status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR WHEN o_orderkey % 3 = 1 THEN ' a<b & "c" ' || o_orderpriority END AS Mixed,
o_totalprice AS __EMPTY, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 2 = 0 END AS Even FROM orders""")
def workbook_scan(spark, sf_dir):
    """All orders through workbooks and back: numbers, texts, truth values, mixed cells, a column without a name."""
    k = F.col("o_orderkey")
    mixed = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit(' a<b & "c" '), "o_orderpriority"))
    even = F.when(k % 5 > 0, F.col("o_custkey") % 2 == 0)
    folder = scratch.new_folder(spark, "workbooks")
    out = _t(spark, sf_dir, "orders").select(k, "o_orderstatus", mixed, "o_totalprice", even).toDF("Order", "Status", "Mixed", "", "Even")
    workbooks.write_workbooks(out, folder, "Orders")
    return workbooks.read_workbook(spark, folder, "Orders")


@registered("SELECT 'Nations' AS sheet, 0 AS position, count(*)::BIGINT AS n, 3 AS columns FROM nation UNION ALL SELECT 'Regions', 0, count(*), 2 FROM region")
def workbook_sheets(spark, sf_dir):
    """Sheets of all workbooks of a folder, with their rows and columns."""
    folder = scratch.new_folder(spark, "workbooks")
    workbooks.write_workbooks(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1), folder, "Nations")
    workbooks.write_workbooks(_t(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1), folder, "Regions")
    rows = workbooks.sheet_rows(spark, folder).groupBy("file", "sheet").agg(F.count_if(F.col("row") > 0).alias("n"), F.max(F.when(F.col("row") == 0, F.size("cells"))).alias("columns"))
    return workbooks.list_sheets(spark, folder).join(rows, ["file", "sheet"]).select("sheet", "position", "n", "columns")


# ---- nested values

_EVENT_JSON = """'{"type": "' || event_type || '", "props": ' || props || ', "at": {"user": ' || user_id || ', "odd": ' || CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'null' ELSE '"' || event_type || '"' END
|| ', "deep": {"x": {"y": 1}, "half": ' || event_id % 7 || '.5}}, "list": [1, 2]' || CASE WHEN event_id % 5 = 0 THEN ', "late": ""' ELSE '' END || '}'"""


def _event_json(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.expr(_EVENT_JSON).alias("j"))


@registered(f"""WITH t AS (SELECT json({_EVENT_JSON}) AS j FROM events), f(name, position, path) AS (VALUES ('type', 0, '$.type'), ('props_k', 1, '$.props.k'), ('at_user', 2, '$.at.user'), ('at_odd', 3, '$.at.odd'), ('at_deep_x', 4, '$.at.deep.x'), ('at_deep_half', 5, '$.at.deep.half'), ('list', 6, '$.list'), ('late', 7, '$.late')),
v AS (SELECT name, position, json_type(j, path) AS k, json_extract_string(j, path) AS x FROM t, f)
SELECT name, position, string_agg(DISTINCT CASE WHEN k = 'VARCHAR' THEN 'text' WHEN k IN ('UBIGINT', 'BIGINT') THEN 'whole' WHEN k = 'DOUBLE' THEN 'number' ELSE lower(k) END, ',' ORDER BY CASE WHEN k = 'VARCHAR' THEN 'text' WHEN k IN ('UBIGINT', 'BIGINT') THEN 'whole' WHEN k = 'DOUBLE' THEN 'number' ELSE lower(k) END) AS kinds, count(*) AS n, count(*) FILTER (k = 'NULL') AS nulls,
count(DISTINCT k || x) FILTER (k NOT IN ('NULL', 'ARRAY', 'OBJECT')) AS "distinct", min(try_cast(x AS DOUBLE)) FILTER (k IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS low, max(try_cast(x AS DOUBLE)) FILTER (k IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS high
FROM v WHERE k IS NOT NULL GROUP BY name, position""")
def json_fields(spark, sf_dir):
    """Every field of the events as JSON texts: order first seen, kinds, counts, distinct values, bounds."""
    return nested.fields(q.with_rows(_event_json(spark, sf_dir), "event_id"), "j").withColumn("kinds", F.array_join("kinds", ","))


@registered("""SELECT event_type AS type, (props::JSON ->> 'k')::BIGINT AS props_k, user_id AS at_user, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 2 THEN event_type END AS at_odd, NULL::VARCHAR AS at_deep_x, (event_id % 7 + 0.5)::DOUBLE AS at_deep_half, NULL::VARCHAR AS list, NULL::VARCHAR AS late FROM events""")
def json_flat(spark, sf_dir):
    """The same texts as a flat table: mixed kinds are text, arrays and deep objects null."""
    return nested.flat(q.with_rows(_event_json(spark, sf_dir), "event_id"), "j")


@registered("SELECT r_regionkey AS z, r_name AS b_c, NULL::VARCHAR AS a, 'later' AS b_d FROM region")
def json_array_scan(spark, sf_dir):
    """One array of objects in a file; columns in the order first seen, and of two fields with one name the later one."""
    folder = scratch.new_folder(spark, "json")
    one = F.concat(F.lit('{"z": '), "r_regionkey", F.lit(', "b": {"c": "'), "r_name", F.lit('", "d": "early"}, "a": [], "b_d": "later"}'))
    _t(spark, sf_dir, "region").coalesce(1).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.option("lineSep", "\n").text(folder)
    return files.read_json(spark, folder)


# ---- facts that are stored by day


@registered("""WITH c AS (SELECT 'event_type' AS "column", event_type AS x, NULL::DOUBLE AS v FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR, user_id FROM events UNION ALL SELECT 'value', value::VARCHAR, value FROM events),
t AS (SELECT 'event_type' AS "column", string_agg(x || '=' || n, ' ' ORDER BY n DESC, x) AS common FROM (SELECT event_type AS x, count(*) AS n FROM events GROUP BY 1))
SELECT "column", count(*) AS n, count(*) FILTER (x IS NULL) AS blanks, count(v) AS numbers, min(v) AS low, max(v) AS high, any_value(t.common) AS common, true AS distinct_near, true AS quantiles_near FROM c LEFT JOIN t USING ("column") GROUP BY 1""")
def sketch_days(spark, sf_dir):
    """Facts of all events stored by day and merged: counts and bounds are exact, commonest values too where a column has few; distinct values and ranks of quantiles lie near the exact ones."""
    events = _t(spark, sf_dir, "events").select("ts", "event_type", "user_id", "value")
    folder = scratch.new_folder(spark, "sketches")
    sketches.save(sketches.by_day(events, "ts"), folder)
    out = sketches.merged(sketches.load(spark, folder))
    exact = events.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("x"), (F.col(c) if c != "event_type" else F.lit(None)).cast("double").alias("v")) for c in ("event_type", "user_id", "value")))).alias("e")).select("e.*")
    exact = exact.join(F.broadcast(out.select("column", "quantiles")), "column").groupBy("column").agg(F.count_distinct("x").alias("exact"), F.count("v").alias("m"), *(F.count_if(F.col("v") < F.col("quantiles")[i]).alias(f"under{i}") for i in range(3)), *(F.count_if(F.col("v") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(3)))
    near = F.lit(True)
    for i, p in enumerate(sketches.QUANTILES):  # the quantile's ranks, first and last, include one within 2 % of the rank asked for
        near = near & ((F.col("m") == 0) | ((F.col(f"under{i}") / F.col("m") <= p + 0.02) & (F.col(f"upto{i}") / F.col("m") >= p - 0.02)))
    common = F.array_join(F.transform(F.array_sort(F.transform("common", lambda x: F.struct((-x["count"]).alias("k"), x["item"].alias("item")))), lambda x: F.concat_ws("=", x["item"], -x["k"])), " ")
    return out.join(exact, "column").select("column", "n", "blanks", "numbers", "low", "high", F.when(F.col("column") == "event_type", common).alias("common"), (F.abs(F.col("distinct") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("distinct_near"), F.coalesce(near, F.lit(True)).alias("quantiles_near"))


# ---- whole rows

_STATES = """WITH a AS (SELECT l_returnflag AS f, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS n, l_quantity AS v FROM lineitem), b AS (SELECT l_returnflag AS f, CASE WHEN l_linenumber < 5 THEN l_linenumber END AS n, l_quantity AS v FROM lineitem WHERE l_discount > 0.01)"""


def _states(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem")
    row = lambda most: [F.col("l_returnflag").alias("f"), F.when(F.col("l_linenumber") < most, F.col("l_linenumber")).alias("n"), F.col("l_quantity").alias("v")]
    return x.select(*row(6)), x.filter("l_discount > 0.01").select(*row(5))


@registered(f"{_STATES} SELECT f, n, v, count(*) AS times FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1, 2, 3")
def rows_except_all(spark, sf_dir):
    """Rows of one state that the other has not as often; all of them are counted, as tables hold equal rows."""
    return sets.except_all(*_states(spark, sf_dir)).groupBy("f", "n", "v").agg(F.count("*").alias("times"))


@registered(f"{_STATES} SELECT f, n, v, count(*) AS times FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) GROUP BY 1, 2, 3")
def rows_intersect_all(spark, sf_dir):
    return sets.intersect_all(*_states(spark, sf_dir)).groupBy("f", "n", "v").agg(F.count("*").alias("times"))


@registered(f"{_STATES}, c AS (SELECT f, n, v, count(*) FILTER (s = 0) AS before, count(*) FILTER (s = 1) AS after FROM (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY 1, 2, 3) SELECT * FROM c WHERE before <> after")
def rows_changed(spark, sf_dir):
    return sets.changes(*_states(spark, sf_dir))


# ---- pages


@registered("""WITH o AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS k, o_orderkey, o_totalprice FROM orders), p AS (SELECT count(*) // 25 // 2 AS middle, (count(*) - 1) // 25 AS last FROM orders)
SELECT k // 25 AS page, o_orderkey, o_totalprice FROM o, p WHERE k // 25 IN (0, middle, last)""")
def pages_by_seek(spark, sf_dir):
    """The first page, one in the middle and the last of all orders by price; each reads the ranges that it lies in."""
    found = pages.Pages.of(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", size=25)
    out = [found.page(k).select(F.lit(k).cast("long").alias("page"), "o_orderkey", "o_totalprice") for k in dict.fromkeys((0, found.count // 25 // 2, found.pages - 1))]
    for more in out[1:]:
        out[0] = out[0].unionAll(more)
    return out[0]


# ---- key figures


@registered("""WITH w AS (SELECT max(o_orderdate) AS m FROM orders), f AS (SELECT o.*, o_orderdate > m - INTERVAL 365 DAY AS cur, o_orderdate > m - INTERVAL 730 DAY AND o_orderdate <= m - INTERVAL 365 DAY AS prev FROM orders o, w)
SELECT 'revenue' AS id, round(sum(o_totalprice) FILTER (cur), 2) AS value, round(sum(o_totalprice) FILTER (prev), 2) AS previous FROM f
UNION ALL SELECT 'orders', count(DISTINCT o_orderkey // 3) FILTER (cur), count(DISTINCT o_orderkey // 3) FILTER (prev) FROM f UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FILTER (cur), count(DISTINCT o_custkey) FILTER (prev) FROM f
UNION ALL SELECT 'aov', round(sum(o_totalprice) FILTER (cur) / count(DISTINCT o_orderkey // 3) FILTER (cur), 2), round(sum(o_totalprice) FILTER (prev) / count(DISTINCT o_orderkey // 3) FILTER (prev), 2) FROM f""")
def kpi_distinct(spark, sf_dir):
    """Orders, customers and the order value in two windows: distinct counts under many conditions by one shuffle."""
    o = _t(spark, sf_dir, "orders").select(F.concat(F.lit(" o"), F.floor(F.col("o_orderkey") / 3)).alias("order_id"), F.concat(F.lit("c"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise("")).alias("customer_id"), "o_orderdate", F.col("o_totalprice").alias("revenue"))
    df = q.with_rows(o)
    found = kpi.kpis(df, prof.profile(df))
    return spark.createDataFrame([(k.id, round(k.value, 2), round(k.previous, 2)) for k in found if k.id in ("revenue", "orders", "customers", "aov")], "id string, value double, previous double")


# ---- streams

#: Rows of a file of the stream, at least.
_FILE_ROWS = 100_000


@registered("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS again FROM events), s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n, sum(again)::BIGINT AS repeats FROM g GROUP BY user_id, k""")
def stream_state_sessions(spark, sf_dir):
    """All events as a stream of files: out of order by up to an hour, a tenth of them twice; a last row moves the watermark over all."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    twice = events.unionAll(events.filter("event_id % 10 = 0"))
    end = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "ts")
    folder = scratch.new_folder(spark, "stream")
    late = F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, pmod(xxhash64(event_id), 3600))")
    rows = twice.withColumn("come", late)
    span = rows.agg(F.min("come").alias("a"), F.max("come").alias("b")).first()
    days = [span["a"] + (span["b"] - span["a"]) * k / 4 for k in range(5)]
    parts = [(F.col("come") >= F.lit(low)) & (F.col("come") < F.lit(high) if high != days[-1] else F.lit(True)) for low, high in zip(days, days[1:], strict=False)]
    # four batches by the time at which rows come, each of as many files, none of them empty: so a batch is written by many tasks
    least = min(rows.agg(*(F.count_if(p).alias(f"n{k}") for k, p in enumerate(parts))).first())
    n_files = max(1, least // _FILE_ROWS)
    for part in parts:
        rows.filter(part).drop("come").repartition(n_files).write.mode("append").parquet(f"{folder}/in")
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", n_files).parquet(f"{folder}/in")
    stateful.write(stateful.sessions(stream, late="3 hours"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "stop")})


# ---- spellings

_TYPED = """CASE o_orderkey % 9 WHEN 0 THEN substr(md5(o_custkey::VARCHAR), 1, 3) || substr(md5(o_custkey::VARCHAR), 5, 8) WHEN 1 THEN upper(substr(md5(o_custkey::VARCHAR), 1, 12)) WHEN 2 THEN substr(md5(o_custkey::VARCHAR), 1, 12) || 's' WHEN 3 THEN 'xy' || substr(md5(o_custkey::VARCHAR), 1, 12) ELSE substr(md5(o_custkey::VARCHAR), 1, 12) END"""


def _typed(spark, sf_dir):
    name = F.md5(F.col("o_custkey").cast("string").cast("binary"))
    whole, k = F.substr(name, F.lit(1), F.lit(12)), F.col("o_orderkey") % 9
    cut = F.concat(F.substr(name, F.lit(1), F.lit(3)), F.substr(name, F.lit(5), F.lit(8)))
    value = F.when(k == 0, cut).when(k == 1, F.upper(whole)).when(k == 2, F.concat(whole, F.lit("s"))).when(k == 3, F.concat(F.lit("xy"), whole)).otherwise(whole)
    return q.with_rows(_t(spark, sf_dir, "orders").select("o_orderkey", value.alias("value")), "o_orderkey")


@registered(f"""WITH c AS (SELECT {_TYPED} AS value, count(*) AS n FROM orders GROUP BY 1)
SELECT a.value AS rare, b.value AS common, b.n FROM c a JOIN c b ON a.value <> b.value AND b.n >= 2 AND b.n >= 2 * a.n
AND (lower(a.value) = lower(b.value) OR lower(a.value) = lower(b.value) || 's' OR lower(b.value) = lower(a.value) || 's' OR levenshtein(lower(a.value), lower(b.value)) <= 2)""")
def spelling_pairs(spark, sf_dir):
    """Every pair of spellings among all orders' names, thousands of values, as a comparison of all with all finds them."""
    counts = _typed(spark, sf_dir).groupBy("value").agg(F.count("*").alias("n"), F.min(q.ROW).alias("first"))
    return spellings.pairs(counts).select("rare", "common", "n")


# ---- bundles and models


@registered("SELECT 'orders' AS name, count(*) AS n, 3 AS columns, 2 AS steps, true AS same_in_any_order, 2 AS members FROM orders UNION ALL SELECT 'customers', count(*), 2, 0, true, 2 FROM customer")
def workspace_bundle(spark, sf_dir):
    """Orders and customers with a recipe through a bundle; digests do not depend on the order of rows."""
    orders = Dataset.of("orders", _t(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit(" ")).alias("status"), F.col("o_totalprice").alias("odd name;"), F.lit("x").alias("note")))
    orders = orders.apply(("dropColumn", "note"), ("trimWhitespace",))
    people = Dataset.of("customers", _t(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    folder = scratch.new_folder(spark, "bundle")
    bundle.save(spark, folder, [orders, people], [{"name": "A", "email": "a@example.org"}, {"name": "B", "email": "b@example.org"}])
    back = bundle.load(spark, folder, [{"name": "A", "email": "a@example.org"}])
    rows = []
    for d in back.datasets:
        plain = d.df.drop(q.ROW)
        rows.append((d.name, plain.count(), len(plain.columns), len(back.recipes[d.name]), bundle.digest(plain) == bundle.digest(plain.repartition(7)), len(back.team)))
    return spark.createDataFrame(rows, "name string, n long, columns int, steps int, same_in_any_order boolean, members int")


@registered("SELECT 'Total O Totalprice' AS name, round(sum(o_totalprice), 2) AS value, count(*) AS rows FROM orders UNION ALL SELECT 'Row Count', count(*), count(*) FROM orders")
def bi_model(spark, sf_dir):
    """The measures of the model of orders with their customers' segment, by the model's own SQL."""
    ds = Dataset.of("sales.csv", _sales(spark, sf_dir).select("o_orderdate", "o_totalprice", "c_mktsegment", "o_orderpriority"))
    found = model.build(ds, pinned=(charts.Chart("bar", "c_mktsegment", None, agg="count"),))
    out = [ds.df.agg(F.expr(m.sql).cast("double").alias("value")).select(F.lit(m.name).alias("name"), F.round("value", 2).alias("value"), F.lit(found.rows).cast("long").alias("rows")) for m in found.measures if m.agg in ("sum", "count")]
    for more in out[1:]:
        out[0] = out[0].unionAll(more)
    return out[0]


# ---- findings


@registered(f"""{_GAPS}
SELECT 'quality_missing' AS id, CASE WHEN gap >= 20 THEN 'critical' WHEN gap >= 5 THEN 'warning' ELSE 'info' END AS severity, round(50 + least(30, gap), 2) AS score FROM (SELECT 100 - round(100.0 * count(v) / count(*), 2) AS gap FROM (SELECT v, o_orderkey FROM m UNION ALL SELECT v, o_orderkey FROM m WHERE o_orderkey % 20 = 0))
UNION ALL SELECT 'quality_duplicates', CASE WHEN s >= 5 THEN 'critical' ELSE 'warning' END, round(55 + least(25, 3 * s), 2) FROM (SELECT 100.0 * count(*) FILTER (o_orderkey % 20 = 0) / (count(*) + count(*) FILTER (o_orderkey % 20 = 0)) AS s FROM m)
UNION ALL SELECT 'quality_consistency', 'warning', 48""")
def insight_defects(spark, sf_dir):
    """Gaps, repeated rows and spaces in all orders, with their severities and scores."""
    gap = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 3 != 0) | (F.col("o_orderkey") % 13 == 0)
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(~gap, F.col("o_totalprice")).alias("amount"), F.concat(F.lit(" "), "o_orderpriority").alias("priority"))
    df = q.with_rows(o.unionAll(o.filter("o_orderkey % 20 = 0")))
    p = prof.profile(df)
    return spark.createDataFrame([(f.id, f.severity, round(float(f.score), 2)) for f in insights.quality(insights.Context(df, p, kpi.read(p, df)))], "id string, severity string, score double")


# ---- pivots of several fields

_TWO = """WITH s AS (SELECT c_mktsegment AS a, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority || ' ' END AS b, o_orderstatus AS c, CASE WHEN o_custkey % 13 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS d, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT trim(a) || '/' || trim(b) AS r, c || '/' || d AS c, v FROM s WHERE trim(b) <> '' AND d IS NOT NULL)"""


def _two(spark, sf_dir):
    second = F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.concat("o_orderpriority", F.lit(" ")))
    parity = F.when(F.col("o_custkey") % 13 == 0, F.lit(None)).when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd")
    return _sales(spark, sf_dir).select(F.col("c_mktsegment").alias("a"), second.alias("b"), F.col("o_orderstatus").alias("c"), parity.alias("d"), F.col("o_totalprice").alias("v"))


@registered(f"{_TWO} SELECT r AS row_path, c AS col_path, min(v) AS v0, max(v) AS v1, count(*)::DOUBLE AS v2 FROM k GROUP BY GROUPING SETS ((r, c), (r), (c), ())")
def pivot_two_fields(spark, sf_dir):
    """Two fields on rows and two on columns; rows with a blank or missing key are left out, paths are trimmed, totals are of source rows."""
    out = piv.pivot(_two(spark, sf_dir), piv.Pivot(("a", "b"), ("c", "d"), (("v", "min"), ("v", "max"), ("v", "count"))))
    return out.drop("is_other").withColumns({"row_path": F.array_join("row_path", "/"), "col_path": F.array_join("col_path", "/")})


@registered(f"{_TWO}, h AS (SELECT DISTINCT split_part(c, '/', 1) AS c, split_part(c, '/', 2) AS d FROM k) SELECT 0 AS level, c AS label, count(*)::INT AS span FROM h GROUP BY c UNION ALL SELECT 1, c || '>' || d, 1 FROM h")
def pivot_header_runs(spark, sf_dir):
    """How many columns each header label spans, level by level."""
    cells_ = piv.pivot(_two(spark, sf_dir), piv.Pivot(("a",), ("c", "d")))
    paths = sorted(tuple(r[0]) for r in cells_.filter("col_path is not null").select("col_path").distinct().collect())
    rows = [(0, label, n) for label, n in piv.header_runs(paths, 0)]
    at = 0
    for label, n in piv.header_runs(paths, 1):
        rows.append((1, f"{paths[at][0]}>{label}", n))
        at += n
    return spark.createDataFrame(rows, "level int, label string, span int")
