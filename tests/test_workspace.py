"""Spellings against all pairs, bundles that were changed, models, and what a finding advises."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import names
from siltstone.operators import charts, insights, kpi, spellings
from siltstone.operators import profile as prof
from siltstone.operators import query as q
from siltstone.plans import bundle, model, report
from siltstone.plans.recipe import Dataset


def typo(r, s):
    for _ in range(r.randint(1, 3)):
        i = r.randrange(len(s) + 1)
        s = r.choice([s[:i] + r.choice("abcé ") + s[i:], s[:i] + s[i + 1 :], s[:i] + r.choice("xyz") + s[i + 1 :]])
    return s


def some_values(n, seed=1):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefé") for _ in range(r.choice([2, 4, 5, 6, 9, 14, 30]))) for _ in range(n // 4)]
    out = {}
    for b in base:
        for v in {b, b.upper(), b + "s", typo(r, b) if len(b) > 2 else b, b + " - x", b + "-x", typo(r, typo(r, b + "longer tail of it"))}:
            if v.strip():
                out[v.strip()] = r.choice([1, 1, 2, 3, 5, 8, 20])
    return out


def test_spellings_are_those_of_all_pairs(spark):
    counts = sorted(some_values(480).items(), key=lambda x: -x[1])
    df = spark.createDataFrame([(v, n, i) for i, (v, n) in enumerate(counts)], "value string, n long, first long")
    want = prof.variants(counts)
    assert len(want) > 100
    found = spellings.pairs(df)
    got = {r["rare"]: r["common"] for r in spellings.resolved(found).collect()}
    assert got == want
    assert found.count() == found.select("rare", "common").distinct().count()


def test_ten_thousand_values(spark):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(2)
    base = [f"{r.getrandbits(44):011x}" for _ in range(3400)]
    values = sorted({v: n for b in base for v, n in ((b, r.choice([2, 6])), (typo(r, b).strip(), 1), (b[:-1], 1))}.items())
    con = duckdb.connect()
    import pandas as pd

    frame = pd.DataFrame(values, columns=["value", "n"])  # noqa: F841  read by name
    want = con.sql("""SELECT a.value, b.value FROM frame a JOIN frame b ON a.value <> b.value AND b.n >= 2 AND b.n >= 2 * a.n AND abs(length(a.value) - length(b.value)) <= 2 AND levenshtein(a.value, b.value) <= 2 AND least(length(a.value), length(b.value)) >= 5""").fetchall()
    got = spellings.pairs(spark.createDataFrame([(v, n, i) for i, (v, n) in enumerate(values)], "value string, n long, first long")).select("rare", "common")
    plain = lambda s: s.isascii() and " ".join(s.split()) == s  # noqa: E731  the other side counts bytes, and keeps blanks
    assert len(values) > 9000 and {(a, b) for a, b in map(tuple, got.collect()) if plain(a) and plain(b)} == {(a, b) for a, b in want if plain(a) and plain(b)}


def test_only_few_values_by_default(spark):
    rows = [("Alpha",)] * 4 + [("alpha",)] + [("Alphas",)] + [(None,), (" ",)]
    df = q.with_rows(spark.createDataFrame(rows, "s string"))
    assert {tuple(r) for r in spellings.variants(df, "s").collect()} == {("alpha", "Alpha"), ("Alphas", "Alpha")}
    many = q.with_rows(spark.createDataFrame(rows + [(f"other {i}",) for i in range(30)], "s string"))
    assert spellings.variants(many, "s").count() == 0
    assert ("alpha", "Alpha") in {tuple(r) for r in spellings.variants(many, "s", None).collect()}
    assert spellings.variants(q.with_rows(spark.createDataFrame([("one",)] * 3, "s string")), "s").count() == 0


# ---- bundles


def test_bundle_round_trip_and_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, 0.5)], "k long, `odd name;` string, x double")
    ds = Dataset.of("odd.csv", df).apply(("trimWhitespace",))
    empty = Dataset.of("none", spark.createDataFrame([], "k int"))
    path = str(tmp_path / "b")
    bundle.save(spark, path, [ds, empty], [{"email": "x"}, {"email": "x"}, {"name": "no mail"}])
    back = bundle.load(spark, path)
    assert [d.name for d in back.datasets] == ["odd.csv", "none"] and back.team == [{"email": "x"}]
    assert back.datasets[0].columns == ["k", "odd name;", "x"]
    assert sorted(map(tuple, back.datasets[0].df.drop(q.ROW).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert back.recipes["odd.csv"] == [("trimWhitespace",)] and back.changelogs["odd.csv"] == ds.changelog()
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        bundle.save(spark, path, [ds])
    spark.createDataFrame([(1, "a", None), (3, "b", 0.5), (2, None, 0.5)], "c0 long, c1 string, c2 double").write.mode("overwrite").parquet(f"{path}/tables/0")
    with pytest.raises(ValueError, match="odd.csv is not as it was written"):
        bundle.load(spark, path)
    with pytest.raises(ValueError, match="no workspace bundle"):
        bundle.load(spark, str(tmp_path / "gone"))


def test_digests_count_repeated_rows_and_tell_places_apart(spark):
    d = lambda rows: bundle.digest(spark.createDataFrame(rows, "a string, b string").repartition(2))
    assert d([("x", None), ("y", "z")]) == d([("y", "z"), ("x", None)])
    assert len({json.dumps(d(r)) for r in ([("x", None)], [(None, "x")], [("x", None)] * 2, [("x", "")], [])}) == 5


# ---- models


def test_boxes_do_not_overlap():
    r = random.Random(1)
    for _ in range(200):
        wide = [r.random() < 0.3 for _ in range(r.randint(0, 9))]
        found = model.boxes(wide, 108)
        for i, a in enumerate(found):
            assert a.x >= model.GAP and a.x + a.width <= model.PAGE[0] - model.GAP and a.width > 600 - 600 * (not wide[i]) - 600 * (not wide[i])
            for b in found[i + 1 :]:
                assert b.y > a.y or b.y == a.y and b.x >= a.x + a.width + model.GAP
    assert [b.y for b in model.boxes([True, False, False, True], 12)] == [12, 274, 274, 536]


def test_model_of_a_table(spark):
    r = random.Random(5)
    rows = [(f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", r.choice("NSEW"), r.choice(["a", "b", "c"]), str(r.randint(1, 900)), str(r.randint(1, 9))) for i in range(300)]
    ds = Dataset.of("My sales (v1).csv", spark.createDataFrame(rows, "order_date string, region string, product string, revenue string, units string"))
    m = model.build(ds, chosen={"region": ["N"]}, pinned=(charts.Chart("bar", "region", "units", agg="avg"),))
    assert (m.name, m.rows) == ("My_sales_v1", 300)
    assert {f.name: (f.type, f.role) for f in m.fields} == {"order_date": ("date", "dimension"), "region": ("string", "dimension"), "product": ("string", "dimension"), "revenue": ("number", "measure"), "units": ("number", "measure")}
    by = {x.name: x for x in m.measures}
    assert by["Average Units"].sql == "AVG(`units`)" and by["Average Units"].dax == "Average Units = AVERAGE('My_sales_v1'[units])" and by["Total Revenue"].tableau == "SUM([revenue])"
    assert {v.measure for v in m.visuals} == set(by) and m.visuals[-1].id == "pinned_0"
    assert {s.column: s.chosen for s in m.slicers}["region"] == ("N",)
    nodes = {f"field:{f.name}" for f in m.fields} | {f"measure:{x}" for x in by}
    assert all(b in nodes for _, b in m.edges())
    lost = m.without("units")
    assert "measure:Average Units" in lost and "visual:pinned_0" in lost and "measure:Total Revenue" not in lost
    assert json.loads(m.to_json())["table"] == "My_sales_v1"
    assert [x.name for x in model.build(ds, only=set()).measures] == ["Row Count"]


# ---- findings


def test_summary_advice_and_ten_sections(spark):
    r = random.Random(5)
    rows = [(f"2024-{1 + i // 25:02d}-{1 + i % 25:02d}", r.choice("NNNSEW"), str(100 + i)) for i in range(300)] + [("2024-12-25", "N ", None)] * 30
    df = q.with_rows(spark.createDataFrame(rows, "order_date string, region string, revenue string"))
    p = prof.profile(df)
    c = insights.Context(df, p, kpi.read(p, df))
    found = insights.analyze(c)
    kinds = {f.id: f.severity for f in found}
    assert kinds["quality_duplicates"] == "critical" and kinds["quality_missing"] == "warning" and kinds["quality_consistency"] == "warning"
    advice = insights.recommendations(found)
    assert 1 < len(advice) <= 8 and len(set(advice)) == len(advice) and all(insights.advice(f) for f in found)
    text = insights.summary(c, "sales", found)
    assert text.startswith("sales: 330 rows, 3 columns, 2024-01-01 to 2024-12-25.") and "Health" in text and "To look at:" in text
    sections = report.build(Dataset.of("sales", df, truncated=True))
    assert len(sections) == 10 and all(lines for _, lines in sections) and sections[0][1][0].startswith("sales: ") and "The file was read in part." in sections[1][1]
    assert insights.summary(insights.Context(df.limit(0), prof.profile(df.limit(0)), c.semantics), "x", []) == "x has no rows."


@pytest.mark.parametrize(("word", "more"), [("box", "boxes"), ("City", "Cities"), ("day", "days"), ("y", "ys"), ("Order", "Orders"), ("branch", "branches")])
def test_plurals(word, more):
    assert names.plural(word) == more


def test_severities_at_their_limits():
    at = lambda kind, *shares: [insights.severity(kind, x) for x in shares]
    assert at("gaps", 4.99, 5, 19.9, 20) == ["info", "warning", "warning", "critical"]
    assert at("repeats", 0.1, 4.9, 5) == ["warning", "warning", "critical"] and at("types", 10, 10.1) == ["info", "warning"]


def test_rows_of_a_pair_are_counted(spark):
    df = spark.createDataFrame([("aaaaa", 4, 0), ("aaaab", 2, 1), ("aaabb", 1, 2)], "value string, n long, first long")
    assert {tuple(r) for r in spellings.pairs(df).select("rare", "common").collect()} == {("aaaab", "aaaaa"), ("aaabb", "aaaaa"), ("aaabb", "aaaab")}
    assert {tuple(r) for r in spellings.resolved(spellings.pairs(df)).collect()} == {("aaaab", "aaaaa"), ("aaabb", "aaaaa")}
    assert df.agg(F.sum("n")).first()[0] == 7


def test_spellings_are_not_broadcast(spark):
    """Eighty rows a text are more than any size estimate of the texts says."""
    df = spark.range(100).selectExpr("concat('value ', id) AS value", "id + 1 AS n", "id AS first")
    assert "Broadcast" not in spellings.pairs(df)._jdf.queryExecution().executedPlan().toString()


def test_a_board_of_orders_that_look_alike_has_full_health(spark, tmp_path):
    """Orders of one day, price, segment and priority are no repeated rows, as the board leaves their key out."""
    from siltstone.plans import catalog

    spark.sql("SELECT id AS o_orderkey, 1L AS o_custkey, timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id % 40 AS INT)) AS o_orderdate, double(100 + id % 40) AS o_totalprice, '1-URGENT' AS o_orderpriority FROM range(80)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS c_custkey, 'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    figures = dict(map(tuple, catalog.QUERIES["dashboard_board"](spark, str(tmp_path)).collect()))
    assert figures["Rows"] == 80 and figures["Health"] == 100
