import pytest
from pyspark.sql import functions as F

from siltstone.operators import aggregates as agg
from siltstone.operators import charts, clean, insights, issues, joins, kpi, missing, outliers, periods
from siltstone.operators import profile as prof
from siltstone.operators import quantiles
from siltstone.operators import query as q
from siltstone.operators import pivot as pivot_module
from siltstone.operators.pivot import OTHER, Pivot, drill, matched_rows, pivot
from siltstone.plans import recipe, report, workflow
from siltstone.sources import sample


def frame(spark, rows, schema):
    return q.with_rows(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_rid long, {schema}"))


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


CITIES = [(1, "Lagos", "1,200", "gold"), (2, "Abuja", "800", "silver"), (3, "Lagos", "600", "AND"), (4, "Kano", "2,000", None), (5, "Jos", None, "")]


def test_two_valued_predicates(spark):
    df = frame(spark, [(None,), ("x",), ("",), ("5",), ("10",), ("-",)], "v string")
    c = F.col("v")
    ids = lambda on: [r["_rid"] for r in df.filter(on).orderBy("_rid").collect()]
    assert ids(q.compare(c, "!=", "X")) == [0, 2, 3, 4, 5]
    assert ids(q.compare(c, "<", "5")) == [0, 2, 5]
    assert ids(q.compare(c, ">", 7)) == [1, 4]
    assert ids(q.compare(c, "=", 5.0)) == [3]
    assert ids(q.like(c, "_%")) == [1, 3, 4, 5]
    assert ids(q.any_of()) == []


def test_groups_and_orders(spark):
    df = frame(spark, CITIES, "id int, city string, amount string, tier string")
    out = df.groupBy("city").agg(q.aggregate("count", None).alias("n"), q.aggregate("sum", F.col("amount")).alias("s"), q.first_value("tier").alias("t"))
    assert got(out, F.desc("n"), "city")[0] == ("Lagos", 2, 1800.0, "gold")
    assert df.agg(q.aggregate("sum", F.col("amount"))).first()[0] == 4600
    assert df.agg(q.aggregate("max", F.col("city"))).first()[0] is None
    assert [r["amount"] for r in q.ordered(df, ("amount", True)).collect()] == ["600", "800", "1,200", "2,000", None]
    assert [r["amount"] for r in q.ordered(df, ("amount", False)).collect()][-1] is None


def test_guard(spark):
    assert q.guard_read_only("-- x\nSELECT 'drop' FROM t;") == "SELECT 'drop' FROM t"
    for bad in ("DELETE FROM t", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO t SELECT 1", ""):
        with pytest.raises(ValueError):
            q.guard_read_only(bad)
    assert q.read_only(spark, "select count(*) as n from tv", tv=spark.range(3)).first()["n"] == 3


def test_joins(spark):
    a = spark.createDataFrame([("K1", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([(" k1", 10), (None, 20)], "k string, v int")
    sizes = {how: joins.join(a, b, "k", "k", how).count() for how in joins.KINDS}
    assert sizes == {"inner": 1, "left": 2, "right": 2, "full": 3}
    out = joins.join(a, spark.createDataFrame([("k1", 10), ("zz", 5)], "name string, v int"), "k", "name", "full")
    assert out.columns == ["k", "v_left", "v_right"] and ("zz", None, 5) in [tuple(r) for r in out.collect()]
    with pytest.raises(ValueError):
        joins.join(a, spark.createDataFrame([(1, 2)], "x int, k int"), "k", "x")


def test_series(spark):
    df = frame(spark, [("a", "1"), ("a", "3"), (" b", "x"), ("", "5"), ("c", "9")], "g string, v string")
    assert got(agg.value_counts(df, "g"), F.desc("value"), "name") == [("a", 2), ("b", 1), ("c", 1)]
    assert got(agg.sum_by(df, "g", "v"), "name") == [("a", 4.0), ("c", 9.0)]
    assert got(agg.top_with_other(agg.sum_by(df, "g", "v"), 1), F.desc("value")) == [("c", 9.0), (OTHER, 4.0)]
    assert [r["n"] for r in agg.histogram(df, "v").orderBy("bin").collect()] == [2, 1, 0, 1] or agg.histogram(df, "v").agg(F.sum("n")).first()[0] == 4
    flat = frame(spark, [("2",)] * 3, "v string")
    assert got(agg.histogram(flat, "v"), "bin") == [(0, 2.0, 2.0, 3)]


PIVOT = [("East", "Q1", "50"), ("East", "Q2", "175"), ("West", "Q1", "$100"), ("West", "Q2", "200"), (" ", "Q1", "7")]


def test_pivot(spark):
    df = frame(spark, PIVOT, "region string, quarter string, revenue string")
    spec = Pivot(("region",), ("quarter",), (("revenue", "sum"), ("revenue", "avg")))
    cells_ = {(tuple(r["row_path"] or ()), tuple(r["col_path"] or ())): r["v0"] for r in pivot(df, spec).collect()}
    assert cells_[("East",), ("Q2",)] == 175 and cells_[("West",), ()] == 300 and cells_[(), ("Q1",)] == 150 and cells_[(), ()] == 525
    assert drill(df, spec, ["East"], None).count() == 2 and matched_rows(df, spec) == 4
    top = Pivot(("region",), (), (("revenue", "sum"),), limit=1)
    rows = {tuple(r["row_path"] or ()): r["v0"] for r in pivot(df, top).filter("col_path is null").collect()}
    assert rows[("West",)] == 300 and rows[(OTHER,)] == 225 and rows[()] == 525
    assert drill(df, top, [OTHER]).count() == 2
    only = Pivot(("region",), (), ((None, "count"),), (("quarter", ("Q1",)),))
    assert matched_rows(df, only) == 2 and only.value_label(0) == "Count of rows"


def test_profile_of_eight_numbers(spark):
    p = prof.profile(frame(spark, [(str(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "x string"))
    c = p["x"]
    assert (c.type, c.std, c.p25, c.median, c.p75, c.outliers) == ("number", 2.14, 4, 4.5, 5.5, 1)
    assert p.health["accuracy"] == 88


def test_types_and_findings(spark):
    rows = [(str(i), f"0{i}", "2024-01-%02d" % (i % 28 + 1), ["LAGOS", "Lagos", "Abuja", "Abuja"][i % 4], " x" if i == 3 else "x", None if i < 5 else "9", str(44000 + i)) for i in range(40)]
    df = frame(spark, rows, "number string, code string, day string, city string, pad string, gap string, `created at` string")
    p = prof.profile(df)
    assert [c.type for c in p.columns] == ["number", "string", "date", "category", "category", "number", "date"]
    assert p["number"].is_index and p["created at"].is_serial and p["pad"].has_space
    rules = [d.rule for d in p.diagnostics]
    assert {"index", "serial", "whitespace", "missing", "casing"} <= set(rules) and rules.index("index") < rules.index("missing")
    skipped = prof.skip(p, "missing")
    assert skipped.health["completeness"] == 100 and p.health["completeness"] < 100
    counts, found = issues.report(df, p)
    assert counts["missing"] == 5 and counts["whitespace"] == 1 and counts["serial"] == 40
    assert any(f["cell"] == "F2" and f["rule"] == "missing" for f in found)
    assert issues.column_letter(26) == "AA"


def test_variants():
    assert prof.variants([("Lagos", 6), ("lagos", 2), ("Lagoss", 1), ("Kano", 3)]) == {"lagos": "Lagos", "Lagoss": "Lagos"}


def test_cleaning(spark):
    df = frame(spark, [(" a  b ", "1"), (" a  b ", "1"), (None, " "), ("x,y , ", "1000"), ("A", "2"), ("A", "3"), ("A", "4")], "t string, n string")
    assert clean.apply(df, ("dropDuplicates",)).count() == 6 and clean.apply(df, ("dropEmptyRows",)).count() == 6
    assert got(clean.apply(df, ("trimWhitespace",)), "_rid")[0][1] == "a b"
    split = clean.apply(df, ("splitColumn", "t", ",")).orderBy("_rid").collect()
    assert tuple(split[3])[1:4] == ("x", "y", None) and split[0]["t_2"] is None
    assert got(clean.apply(df, ("fillMissing", "n", "median")), "_rid")[2][2] == "2.5"
    assert got(clean.apply(df, ("fillMissing", "t", "mode")), "_rid")[2][1] == "A"
    assert float(got(clean.apply(df, ("capOutliers", "n")), "_rid")[3][2]) < 1000
    assert clean.apply(df, ("dropOutlierRows", "n")).count() == 6
    assert got(clean.apply(df, ("findReplace", "t", "a", "$1")), "_rid")[4][1] == "$1"
    cells_, rows = clean.changes(df, ("trimWhitespace",))
    assert cells_.filter("column = 't'").count() == 3 and rows.count() == 0
    assert [r["row"] for r in clean.changes(df, ("dropDuplicates",))[1].collect()] == [1]


def test_recipes(spark):
    df = frame(spark, [(" a ", "1"), ("a", "1")], "t string, n string")
    text = recipe.to_json("x", [("trimWhitespace",), ("dropDuplicates",), ("dropColumn", "gone"), ("splitColumn", "t", "-")])
    source, ops = recipe.from_json(text)
    out, applied, skipped = recipe.replay(df, ops)
    assert source == "x" and out.count() == 1 and [s[1] for s in skipped] == ["gone"] and len(applied) == 3
    for bad in ("{", "{}", '{"version": 1, "ops": [["boom"]]}'):
        with pytest.raises(ValueError):
            recipe.from_json(bad)
    ds = recipe.Dataset.of("d", df)
    once = ds.apply(("trimWhitespace",)).apply(("dropDuplicates",))
    assert once.df.count() == 1 and once.undo().df.count() == 2 and once.undo().redo().df.count() == 1
    assert once.undo().apply(("dropEmptyRows",)).redo().df.count() == 2


def sales(spark, n=120):
    import datetime as dt

    rows = [(f"o{i}", f"c{i % 25}", ["East", "West", "North"][i % 3], str(100 + i % 7 + 100 * (i >= n // 2)), str(60 + i % 5), str(dt.date(2024, 1, 1) + dt.timedelta(days=i))) for i in range(n)]
    return frame(spark, rows, "order_id string, customer_id string, region string, revenue string, cost string, order_date string")


def test_key_figures(spark):
    df = sales(spark)
    p = prof.profile(df)
    found = kpi.kpis(df, p)
    by = {k.id: k for k in found}
    assert found[0].label == "Total Revenue" and len(found) == 6 and {"derived_profit", "margin", "orders", "customers", "aov"} <= set(by)
    assert by["revenue"].previous is not None and by["customers"].label == "Customers"
    assert kpi.windows(df, "order_date").days == 30


def test_charts(spark):
    df = sales(spark)
    p = prof.profile(df)
    s = kpi.read(p, df)
    assert charts.recommend(p, "order_date") == "line" and charts.recommend(p, "revenue") == "histogram" and charts.recommend(p, "region") == "doughnut"
    panels = charts.dashboard(df, p, s)
    assert 3 <= len(panels) <= 8 and all(charts.series(df, p, c).count() > 0 for c in panels)
    assert charts.apply_filters(df, {"region": ["East"]}).count() == 40 and set(charts.filters(df, p, s)["region"]) == {"East", "West", "North"}


def test_outliers(spark):
    rows = [("basic" if i % 20 else "enterprise", str(100 + i % 17)) for i in range(200)] + [("enterprise", "9000")] * 6
    found = outliers.investigate(frame(spark, rows, "tier string, amount string"), "amount", ["tier"], [])
    assert found["outliers"] == 6 and found["segments"][0]["segment"] == "enterprise" and found["sentinel"] == (9000.0, 6)
    assert [r[0] for r in found["readings"]][-1] == "genuine" and "segment" in [r[0] for r in found["readings"]]


def test_missing_mechanism(spark):
    mar = [(["EMEA", "LATAM"][i % 2], None if i % 2 and i % 10 < 8 else "5", "2024-%02d-01" % (i // 40 + 1)) for i in range(400)]
    found = missing.mechanism(frame(spark, mar, "region string, revenue string, day string"), "revenue", ["region"], ["day"])
    assert found["verdict"] == "MAR" and found["associations"][0]["column"] == "region"
    mcar = [(["EMEA", "LATAM"][i % 2], None if i % 7 == 0 else "5", "2024-%02d-01" % (i // 40 + 1)) for i in range(400)]
    assert missing.mechanism(frame(spark, mcar, "region string, revenue string, day string"), "revenue", ["region"], ["day"])["verdict"] == "MCAR"
    late = [("x", None if i >= 100 else "5", "2024-01-%02d" % (i // 8 + 1)) for i in range(200)]
    assert missing.mechanism(frame(spark, late, "region string, revenue string, day string"), "revenue", [], ["day"])["timing"]["column"] == "day"


def test_insights_and_report(spark):
    df = sales(spark)
    p = prof.profile(df)
    found = insights.analyze(insights.Context(df, p, kpi.read(p, df)))
    assert any(f.kind == "trend" for f in found) and found == sorted(found, key=lambda f: -f.score)
    goal = frame(spark, [(r, "65", "100") for r in ("N", "S", "E", "W") for _ in range(10)], "region string, sales string, sales_target string")
    gp = prof.profile(goal)
    (t,) = insights.targets(insights.Context(goal, gp, kpi.read(gp, goal)))
    assert t.severity == "critical" and t.figures["attainment"] == 65
    text = report.markdown(report.build(recipe.Dataset.of("sales", df)))
    assert "## Key figures" in text and "Total Revenue" in text


def test_periods(spark):
    a = frame(spark, [("East", "1000"), ("West", "1000"), ("East", "1000"), ("West", "1000")], "Region string, Revenue string")
    b = frame(spark, [("East", "1000"), ("West", "1000"), ("LATAM", "2000"), ("West", "1000")], "region string, revenue string")
    p, r = prof.profile(a), prof.profile(b)
    assert periods.similarity(periods.Fingerprint.of(p), periods.Fingerprint.of(r)) == 100
    assert periods.recurring(periods.Fingerprint.of(r), [("old", periods.Fingerprint.of(p), 1, frozenset())]) == "old"
    same = b.withColumnsRenamed({"region": "Region", "revenue": "Revenue"})
    d = periods.diff(a, same, p, prof.profile(same))
    assert d["numbers"][0]["change"] == 25 and d["categories"]["Region"]["appeared"] == ["LATAM"]
    assert any("LATAM appeared" in s for s in periods.narrative(d))


def test_workflows(spark):
    df = frame(spark, [(" a ", "1")], "t string, n string")
    w = workflow.Workflow("w", (("trimWhitespace",), charts.Chart("bar", "t", "n"), charts.Chart("bar", "gone")))
    out, kept, skipped = workflow.Workflow.from_json(w.to_json()).apply(df)
    assert out.first()["t"] == "a" and kept == [w.steps[1]] and skipped == [w.steps[2]]
    assert w.moved(0, 2).steps[2] == ("trimWhitespace",) and len(w.removed(1).steps) == 2 and w.moved(0, 9) is w
    for bad in ("[", "{}", '{"version": 1, "steps": [1]}'):
        with pytest.raises(ValueError):
            workflow.Workflow.from_json(bad)


def test_search_answers_and_sample(spark):
    labels = spark.createDataFrame([("Sales",), ("Sales report",), ("Net sales",), ("Presales",), ("s-a-l-e-s",), ("x",)], "l string")
    assert [r["score"] for r in workflow.search(labels, "l", "sales").collect()] == [1000, 800, 600, 400, 100]
    df = q.with_rows(sample.churn(spark))
    p = prof.profile(df)
    assert p.rows == 52 and p.duplicates == 1 and p.blank_rows and "52 rows" in workflow.answer(p, "How many rows?")
    assert "monthly_charge is a number" in workflow.answer(p, "tell me about monthly_charge") and "repeat" in workflow.answer(p, "any duplicates?")


def test_index_columns_by_several_tasks(spark):
    """Numbers in row order count as an index whatever the partitions; shuffled, repeated or broken ones do not."""
    for parts in (1, 2, 4, 7):
        df = spark.range(0, 1000, 1, parts).select("id", (F.col("id") + 1).alias("from_one"), F.floor(F.col("id") / 2).alias("twice"), ((F.col("id") * 7) % 1000).alias("mixed"), F.when(F.col("id") != 5, F.col("id")).alias("gap"))
        p = prof.profile(q.with_rows(df))
        assert {c.name for c in p.columns if c.is_index} == {"id", "from_one"}, parts  # a null leaves a gap in the numbers


def test_top_values_of_a_column_of_many(spark):
    rows = [(f"v{i % 40}" if i % 3 else " often ", "x" * 3000 + str(i)) for i in range(600)]
    p = prof.profile(q.with_rows(spark.createDataFrame(rows, "a string, long string").repartition(4)))
    assert p["a"].unique == 41 and p["a"].top[0] == ("often", 200) and len(p["a"].top) == 5 and len(p["long"].top) == 5
    assert prof.profile(q.with_rows(spark.createDataFrame([], "a string"))).rows == 0


def test_a_real_other_beside_the_tail(spark):
    df = frame(spark, [(OTHER, "5"), (OTHER, "5"), ("a", "1"), ("b", "2")], "k string, v string")
    spec = Pivot(("k",), (), (("v", "sum"),), limit=1)
    got = {(r["is_other"], r["v0"]) for r in pivot(df, spec).filter("row_path is not null and col_path is null").collect()}
    assert got == {(False, 10.0), (True, 3.0)}
    assert drill(df, spec, [OTHER]).count() == 2 and drill(df, spec, [OTHER], is_other=False).filter("v = '5'").count() == 2


def test_pivot_grid_and_csv(spark):
    df = frame(spark, [*PIVOT, ("Lagos, NG", "Q1", "5")], "region string, quarter string, revenue string")
    spec = Pivot(("region",), ("quarter",), (("revenue", "sum"),))
    lines = pivot_module.matrix(pivot(df, spec), spec)
    assert len({len(x) for x in lines}) == 1 and lines[0][0] == "quarter" and lines[-1][0] == "Total" and lines[-1][-1] == 530
    assert '"Lagos, NG",5,,5' in pivot_module.to_csv(lines)
    two = Pivot(("region",), (), (("revenue", "sum"), (None, "count")))
    text = pivot_module.to_csv(pivot_module.matrix(pivot(df, two), two))
    assert "Sum of revenue" in text and "Count of rows" in text
    assert pivot_module.header_runs([("a", "x"), ("a", "y"), ("b", "x")], 0) == [("a", 2), ("b", 1)]


def test_differences_of_operations(spark):
    df = frame(spark, [("  Ada  ", "Kano", 10), ("Bob", "kano", 20), ("Bob", "kano", 20), ("Cleo", "Jos", 30)], "name string, city string, amount int")
    d = clean.difference(df, ("trimWhitespace",))
    assert (d.changed_cells, d.affected, d.removed_rows) == (1, ["name"], 0) and d.detail.collect()[0]["before"] == "  Ada  "
    d = clean.difference(df, ("dropDuplicates",))
    assert d.removed_rows == 1 and d.changed_cells == 0 and d.after.count() == 3
    d = clean.difference(df, ("dropColumn", "city"))
    assert d.removed == ["city"] and d.added == [] and d.changed_cells == 0
    d = clean.difference(frame(spark, [("  x  ",)] * 200, "a string"), ("trimWhitespace",), 10)
    assert d.changed_cells == 200 and d.detail.count() == 10


def test_rows_that_repeat_often_keep_the_first(spark):
    df = q.with_rows(spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("a b"), F.lit(None).cast("string").alias("n")))
    out = clean.apply(df, ("dropDuplicates",))
    assert out.columns == df.columns and out.count() == 2001 and out.filter("`a b` = 'hot'").first()[q.ROW] == df.agg(F.min(q.ROW)).first()[0]


def test_unknown_columns_and_envelope(spark):
    df = frame(spark, [("a", 1)], "Name string, n int")
    assert q.unknown_columns(df, ["Name", "name"]) == ["name"]
    with pytest.raises(ValueError):
        q.known(df, "name")
    bad = q.ask(spark, "SELECT gone FROM t_envelope", t_envelope=df)
    assert bad.df is None and "gone" in bad.error and bad.ms >= 0.1


def test_quantiles_in_bounded_memory_are_exact(spark):
    df = spark.range(0, 4000, 1, 5)
    h = F.abs(F.xxhash64("id"))
    values = {
        "spread": (h % 1_000_003).cast("double") / 7,
        "ties": F.when(F.col("id") % 3 != 0, F.lit(1.5)).otherwise(h % 900),
        "heavy ends": F.when(F.col("id") < 2000, F.lit(-1e300)).when(F.col("id") < 3000, F.lit(1e300)).otherwise(h % 77777),
        "two": (F.col("id") % 2).cast("double"),
        "skewed": F.exp((h % 1000) / 50) * F.when(h % 2 == 0, -1).otherwise(1),
        "holes": F.when(F.col("id") % 5 == 0, h % 5000),
        "none": F.lit(None).cast("double"),
        "one": F.when(F.col("id") == 7, 3.5),
    }
    fractions = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = df.agg(*(F.percentile(v, F.array(*map(F.lit, fractions))).alias(k) for k, v in values.items()), *(F.count(v).alias(f"n {k}") for k, v in values.items())).first()
    for most, accuracy in ((10, 50), (100, 1000), (10**6, 10_000)):
        found = quantiles.exact(df, values, fractions, most=most, accuracy=accuracy)
        for k in values:
            assert found[k][0] == pytest.approx(want[k] or []) and found[k][1] == want[f"n {k}"], (k, most)


def test_issues_are_counted_as_they_are_listed(spark):
    rows = [(" a ", "5", "2024-01-02", 1.0), ("a", "x", "45000", 2.0), ("a", "$7", "2024-02-30", -0.0), (None, "(3)", "1/2/2024", 0.0), ("  ", "5000", None, float("nan")), ("a", "x", "45000", 2.0), ("Ã©a", "4", "2024-03-01", 900.0)] * 3
    df = q.with_rows(spark.createDataFrame(rows, "a string, n string, d string, v double").coalesce(1))
    p = prof.profile(df)
    counts, first = issues.report(df, p, 5)
    listed = issues.cell_issues(df, p)
    assert counts == {r["rule"]: r["count"] for r in listed.groupBy("rule").count().collect()}
    assert [r["row"] for r in first] == [r["row"] for r in listed.orderBy("row", "column").limit(5).collect()]
    assert p.duplicates == 15 and [c.unique for c in p.columns] == [3, 6, 5, 6]


def test_an_index_column_may_have_gaps_of_null(spark):
    rows = [(k, None if k % 25 == 0 else k - k // 25 - 1) for k in range(1, 101)]
    df = q.with_rows(spark.createDataFrame(rows, "k long, v long"), "k")
    assert prof.index_columns(df, ["v"], 100) == {"v"}
    assert prof.index_columns(df.withColumn("v", F.when(F.col("k") == 60, 0).otherwise(F.col("v"))), ["v"], 100) == set()
