"""Nested values, stored sketches, whole-row sets, pages and distinct counts on small odd tables."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.operators import kpi, nested, pages, sets, sketches
from siltstone.operators import query as q
from siltstone.sources import files

# ---- nested values


def flat_by_hand(x, prefix="", depth=1):
    out = {}
    for k, v in x:
        if isinstance(v, list) and v[:1] == ["{}"]:
            if depth < 3:
                out |= flat_by_hand(v[1:], f"{prefix}{k}_", depth + 1)
            else:
                out[f"{prefix}{k}"] = None
        else:
            out[f"{prefix}{k}"] = None if isinstance(v, list) or v == "" else v
    return out


def written(x):
    """JSON of a list of pairs marked with {}, which may hold a key twice."""
    if isinstance(x, list) and x[:1] == ["{}"]:
        return "{" + ", ".join(f"{json.dumps(k)}: {written(v)}" for k, v in x[1:]) + "}"
    return json.dumps(x)


def some_object(r, depth=0):
    keys = ["z", "a", "b", "a_b", "k.x", "é", "with space", "q'"]
    value = lambda: some_object(r, depth + 1) if depth < 4 and r.random() < 0.3 else r.choice([1, -7, 2.5, True, False, None, "", "text", [1, [2]], "x\"y", 1e300])
    return ["{}", *[(r.choice(keys), value()) for _ in range(r.randint(0, 5))]]


def test_flat_tables_are_those_by_hand(spark):
    r = random.Random(4)
    rows = [some_object(r) for _ in range(300)]
    texts = [written(x) for x in rows]
    df = q.with_rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, j string"), "i")
    want = [flat_by_hand(x[1:]) for x in rows]
    names = list(dict.fromkeys(k for x in want for k in x))
    assert [n for n, _ in nested.flat_names(df, "j")] == names
    flat = nested.flat(df, "j")
    assert flat.columns == names
    types = dict(flat.dtypes)
    for got, x in zip(flat.collect(), want, strict=True):
        for name in names:
            v = x.get(name)
            if types[name] == "string" and v is not None:
                v = str(v).lower() if isinstance(v, bool) else v
                assert got[name] == v or isinstance(v, (int, float)) and float(got[name]) == v, (name, x)
            else:
                assert got[name] == v, (name, x)


def test_fields_of_odd_texts(spark):
    df = spark.createDataFrame([(0, '{"z": 1, "b": {"y": "t"}, "z": "dup"}'), (1, "[1]"), (2, "broken"), (3, None), (4, ""), (5, "{}"), (6, '{"b": {"y": null}, "new": [], "z": 3}')], "i long, j string")
    got = {r["name"]: r for r in nested.fields(q.with_rows(df, "i"), "j").collect()}
    assert {k: (r["position"], r["kinds"], r["n"], r["nulls"], r["distinct"], r["low"], r["high"]) for k, r in got.items()} == {
        "z": (0, ["text", "whole"], 2, 0, 2, 3.0, 3.0),
        "b_y": (1, ["null", "text"], 2, 1, 1, None, None),
        "new": (2, ["array"], 1, 0, 0, None, None),
    }
    with pytest.raises(ValueError, match="no fields"):
        nested.flat(q.with_rows(df.filter("i in (1, 2, 3, 4, 5)"), "i"), "j")
    assert nested.schema(df.filter("i = 6"), "j") == "OBJECT<b: OBJECT<y: VOID>, new: ARRAY<VOID>, z: BIGINT>"


def test_leaves_by_the_helper_are_those_of_expressions(spark):
    r = random.Random(6)
    values = ["1", "-0", "1.0", "2.50", "0.5", "-0.01", "0.00001", "1e5", "9223372036854775808", "NaN", "01", '"12"', '"\\u0041"', '"a\\n"', '"é"', "'a'", "[1, {}]", '{"b": {"c": {"d": 1}}}', '{"x": 1, "x": 2}', "null"]
    texts = [written(some_object(r)) for _ in range(100)] + [f'{{"k": {v}, "o": {{"v": {v}, "t": "true"}}}}' for v in values] + ["", "[1]", '{"a": 1} x', '{"a": 1', " {} ", None]
    df = spark.createDataFrame([(t,) for t in texts], "j string").coalesce(1)
    j = F.col("j")
    plain, slow, both = nested._plain_leaves(3)(j), nested._bound(j, lambda t: nested._level(t, F.lit(""), 3)), nested.leaves(j)
    rows = df.select("j", plain.alias("p"), slow.alias("s"), both.alias("b")).collect()
    assert all(x["b"] == x["s"] and x["p"] in (None, x["s"]) for x in rows)
    assert sum(x["p"] is not None for x in rows) > 40


def test_each_step_of_a_text_is_worked_out_once(spark):
    text = F.col("id").cast("string")
    plan = spark.range(1).select(nested._bound(text, lambda t: nested._level(t, F.lit(""), 3)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_of_variant") <= 3  # once for each level; 56 when every mention was an expression of its own


def test_fields_by_hand_without_a_shuffle_of_rows(spark):
    r = random.Random(8)
    texts = [written(some_object(r)) for _ in range(200)] + ['{"z": 1, "a": {"b": 1}, "z": 1, "a_b": null, "z": null}']
    df = q.with_rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, j string"), "i")
    found = nested.fields(df, "j")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(name" in plan and f"{q.ROW}#" in plan and not any("hashpartitioning" in line and q.ROW in line for line in plan.splitlines())
    leaves = df.select(q.ROW, nested.leaves(F.col("j")).alias("x")).collect()
    first, last = {}, {}
    for row, x in sorted((d[0], d["x"]) for d in leaves if d["x"] is not None):
        for k, e in enumerate(x):
            first.setdefault(e["name"], (row, k))
            last[e["name"], row] = (e["kind"], e["text"])
    for d in found.collect():
        mine = [v for (n, _), v in last.items() if n == d["name"]]
        assert (d["position"], d["n"], d["nulls"]) == (sorted(first.values()).index(first[d["name"]]), len(mine), sum(k == "null" for k, _ in mine))
        assert (d["kinds"], d["distinct"]) == (sorted({k for k, _ in mine}), len({v for v in mine if v[1] is not None}))


def test_clashing_names_and_order_of_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"z": 1, "a": {"b": 1}, "a_b": 2}\n\n{"a_b": 3, "a": {"b": 4}, "m": ""}\n')
    df = files.load(spark, str(tmp_path / "a.jsonl"))
    assert df.columns == ["z", "a_b", "m"] and [tuple(r) for r in df.collect()] == [(1, 2, None), (None, 4, None)]
    (tmp_path / "one.json").write_text('\n {"only": true}')
    assert [tuple(r) for r in files.load(spark, str(tmp_path / "one.json")).collect()] == [(True,)]


# ---- files


def test_csv_of_blanks_headers_and_quoted_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,t\n1,"a\nb"\n , \n\n"",""\n2,\n')
    assert [tuple(r) for r in files.load(spark, str(tmp_path / "a.csv")).collect()] == [("1", "a\nb"), ("2", None)]
    (tmp_path / "b.csv").write_text('n,t\n1,"say ""hi"""\n')
    assert not files._spans_lines(spark, str(tmp_path / "b.csv")) and files._spans_lines(spark, str(tmp_path / "a.csv"))
    assert files.load(spark, str(tmp_path / "b.csv")).first()["t"] == 'say "hi"'
    (tmp_path / "c.csv").write_text("n,t\n , \n")
    with pytest.raises(ValueError, match="no rows"):
        files.load(spark, str(tmp_path / "c.csv"))


# ---- sketches


def test_merged_days_equal_one_pass_within_the_bounds(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"2024-01-{1 + i % 5:02d}", r.choice(["a", "b", "b", "c", " ", None]), r.lognormvariate(0, 2) if i % 10 else None, i % 7000) for i in range(30_000)] + [(None, "d", 1.0, 5)]
    df = spark.createDataFrame(rows, "d string, s string, x double, k long")
    facts, path = sketches.by_day(df, "d"), str(tmp_path / "store")
    sketches.save(facts, path)
    got = {x["column"]: x for x in sketches.merged(sketches.load(spark, path)).collect()}
    once = {x["column"]: x for x in sketches.merged(sketches.by_day(df.withColumn("d", F.lit("2024-01-01")), "d")).collect()}
    for c in ("s", "x", "k"):
        for name in ("n", "blanks", "numbers", "low", "high"):
            assert got[c][name] == once[c][name]
        exact = len({v for v in ({"s": 1, "x": 2, "k": 3}[c] and [row[{"s": 1, "x": 2, "k": 3}[c]] for row in rows]) if v is not None and str(v).strip()})
        assert abs(got[c]["distinct"] - exact) <= 0.03 * exact and abs(got[c]["distinct"] - once[c]["distinct"]) <= 0.02 * exact
    values = sorted(row[2] for row in rows if row[2] is not None)
    for x in (got, once):
        for p, v in zip(sketches.QUANTILES, x["x"]["quantiles"], strict=True):
            assert abs(sum(u <= v for u in values) / len(values) - p) <= 0.02
    assert got["s"]["quantiles"] is None
    counts = Counter(row[1] for row in rows if row[1] and row[1].strip())
    assert [(v["item"], v["count"]) for v in got["s"]["common"]] == counts.most_common()


def test_a_day_that_comes_again_is_replaced_and_spans_are_pruned(spark, tmp_path):
    path = str(tmp_path / "store")
    day = lambda d, n: spark.createDataFrame([(d, i) for i in range(n)], "d string, k long")
    sketches.save(sketches.by_day(day("2024-01-01", 5).union(day("2024-01-02", 7)), "d"), path)
    sketches.save(sketches.by_day(day("2024-01-02", 9), "d"), path)
    total = lambda *span: sketches.merged(sketches.load(spark, path, *span)).first()["n"]
    assert (total(), total("2024-01-02"), total(None, "2024-01-01")) == (14, 9, 5)
    assert sketches.merged(sketches.load(spark, path, "2025-01-01")).count() == 0
    plan = sketches.load(spark, path, "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    by_month = sketches.merged(sketches.load(spark, path), F.date_trunc("month", "day").alias("month")).collect()
    assert [(str(x["month"])[:7], x["n"]) for x in by_month] == [("2024-01", 14)]


# ---- sets


def test_sets_count_repeated_rows(spark):
    r = random.Random(6)
    value = lambda: (r.choice([None, "a", "b"]), r.choice([None, "a", "b"]), r.choice([None, 0.0, -0.0, 1.5, float("nan")]), r.choice([None, [1], [None]]))
    a, b = [value() for _ in range(400)], [value() for _ in range(300)]
    schema = "s string, S string, x double, l array<int>"
    left, right = (spark.createDataFrame(x, schema).repartition(3) for x in (a, b))
    plain = lambda x: tuple("nan" if v != v else v + 0.0 if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in x)
    ca, cb = Counter(map(plain, a)), Counter(map(plain, b))
    counted = lambda df: Counter(plain(tuple(x)) for x in df.collect())
    assert counted(sets.except_all(left, right)) == ca - cb
    assert counted(sets.intersect_all(left, right)) == ca & cb
    changed = {plain(tuple(x)[:4]): tuple(x)[4:] for x in sets.changes(left, right).collect()}
    assert changed == {k: (ca[k], cb[k]) for k in ca | cb if ca[k] != cb[k]}
    assert sets.except_all(left, left).count() == 0 and sets.except_all(left, right).columns == ["s", "S", "x", "l"]
    with pytest.raises(ValueError, match="differ"):
        sets.except_all(left, right.select("x"))


def test_a_row_that_fills_the_table(spark):
    a, b = spark.range(20_000).select(F.lit("x").alias("v")), spark.range(19_990).select(F.lit("x").alias("v"))
    assert sets.except_all(a, b).count() == 10 and sets.intersect_all(a, b).count() == 19_990


# ---- pages


def test_pages_are_slices_of_the_order(spark):
    r = random.Random(9)
    rows = [(i, r.choice([None, 1.0, 2.0, 3.5])) for i in range(1003)]
    found = pages.Pages.of(spark.createDataFrame(rows, "k int, v double"), F.desc_nulls_last("v"), "k", size=20)
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert (found.count, found.pages) == (1003, 51)
    for k in range(51):
        assert [tuple(x) for x in found.page(k).collect()] == order[20 * k : 20 * k + 20]
    assert found.page(51).count() == 0 and found.page(-1).count() == 0
    empty = pages.Pages.of(spark.createDataFrame([], "k int"), "k")
    assert (empty.count, empty.pages, empty.page(0).count()) == (0, 0, 0)


def test_a_far_page_reads_one_range(spark):
    found = pages.Pages.of(spark.range(200_000).select(F.col("id").alias("k"), F.lit("text").alias("t")), "k", size=10)
    far = found.page(10_000)
    assert [x["k"] for x in far.collect()] == list(range(100_000, 100_010))
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(__range" in plan.replace("isnotnull(__range", "(__range") and "PushedFilters: [" in plan
    assert len(far.inputFiles()) >= 1 and far.select(F.input_file_name()).distinct().count() == 1


# ---- distinct counts


def test_distinct_counts_under_conditions(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", " a", "b ", "", None, "c"]), r.choice([1, 2, None]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, k int, i int")
    conditions = [F.lit(True), F.col("i") < 20, F.col("i") > 500, F.when(F.col("i") > 3, F.lit(None)).otherwise(F.lit(True))]
    wanted = [("s", None), ("k", None), ("s", F.col("k") == 1)]
    met = [lambda i: True, lambda i: i < 20, lambda i: i > 500, lambda i: i <= 3]
    clean = lambda v: str(v).strip() if v is not None else ""
    want = [[len({clean(x[0 if n == "s" else 1]) for x in rows if f(x[2]) and (also is None or x[1] == 1)} - {""}) for f in met] for n, also in wanted]
    assert kpi.distinct_counts(df, wanted, conditions) == want
    assert kpi.distinct_counts(df.limit(0), wanted, conditions) == [[0] * 4] * 3
