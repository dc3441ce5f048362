"""Outlier investigation: which values lie outside the fences, where they gather, and how they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators.aggregates import numeric
from siltstone.operators.quantiles import exact
from siltstone.operators.query import ROW, col

MOST = 50
LEAST_ROWS = 8
SEGMENT_ROWS = 5


def limits(df: DataFrame, name: str) -> tuple[float, float, float] | None:
    """Lower and upper fence and quartile range; none for under 8 numbers or no spread."""
    n = numeric(df, name)
    q, count = exact(df, {name: n}, [0.25, 0.75])[name]
    if count < LEAST_ROWS or q[1] <= q[0]:
        return None
    iqr = q[1] - q[0]
    return q[0] - 1.5 * iqr, q[1] + 1.5 * iqr, iqr


def marked(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    """Rows that show a number, with it (v) and whether it is outside (out)."""
    return df.withColumn("v", numeric(df, name)).filter("v is not null").withColumn("out", (F.col("v") < low) | (F.col("v") > high))


def records(df: DataFrame, name: str, low: float, high: float, iqr: float, most: int = MOST) -> DataFrame:
    """The most extreme rows: row, value, deviation in quartile ranges past the fence."""
    out = marked(df, name, low, high).filter("out")
    far = F.when(F.col("v") < low, (F.lit(low) - F.col("v")) / iqr).otherwise((F.col("v") - high) / iqr)
    return out.select(F.col(ROW).alias("row"), F.col("v").alias("value"), far.alias("deviation")).orderBy(F.desc("deviation"), "row").limit(most)


def summary(df: DataFrame, name: str, low: float, high: float) -> dict:
    """Counts and shares of rows and of value, and what the readings rest on."""
    rows = marked(df, name, low, high)
    v, out = F.col("v"), F.col("out")
    x = rows.agg(
        F.count("*").alias("n"), F.count_if(out).alias("outliers"), F.sum(v).alias("total"), F.sum(F.when(out, v)).alias("outside"),
        F.count_if(v < 0).alias("negative"), F.count_if(out & (v < 0)).alias("negative_out"), F.count_if(out & (v % 100 == 0)).alias("round"),
    ).first().asDict()
    x["base_rate"] = x["outliers"] / x["n"] if x["n"] else 0.0
    x["value_share"] = abs(x["outside"] or 0) / abs(x["total"]) if x["total"] else 0.0
    again = rows.filter(out).groupBy("v").count().filter("count >= 3").orderBy(F.desc("count"), "v").first()
    x["sentinel"] = (again["v"], again["count"]) if again else None
    return x


def segments(df: DataFrame, name: str, dimensions: list[str], low: float, high: float, least: int = SEGMENT_ROWS) -> DataFrame:
    """column, segment, n, outliers, rate of every segment of the dimensions, one aggregation."""
    rows = marked(df, name, low, high)
    long = rows.select("out", F.explode(F.array(*(F.struct(F.lit(d).alias("column"), cells.trim(col(d)).alias("segment")) for d in dimensions))).alias("x")).select("out", "x.*")
    counts = long.filter("segment != ''").groupBy("column", "segment").agg(F.count("*").alias("n"), F.count_if("out").alias("outliers"))
    return counts.filter(F.col("n") >= least).withColumn("rate", F.col("outliers") / F.col("n"))


def contrasts(df: DataFrame, name: str, others: list[str], low: float, high: float) -> DataFrame:
    """column, outlier_mean, normal_mean, ratio of other measures."""
    rows = marked(df, name, low, high)
    means = [F.struct(F.lit(o).alias("column"), F.avg(F.when(F.col("out"), numeric(df, o))).alias("outlier_mean"), F.avg(F.when(~F.col("out"), numeric(df, o))).alias("normal_mean")) for o in others]
    got = rows.agg(F.array(*means).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    return got.withColumn("ratio", F.try_divide("outlier_mean", "normal_mean"))


def investigate(df: DataFrame, name: str, dimensions: list[str], others: list[str]) -> dict | None:
    """Fences, summary, extreme records, segments with twice the base rate, contrasts, and readings of the cause."""
    found = limits(df, name)
    if found is None:
        return None
    low, high, iqr = found
    x = summary(df, name, low, high)
    parts = segments(df, name, dimensions, low, high).filter(F.col("rate") >= 2 * x["base_rate"]).filter("outliers > 0").orderBy(F.desc("rate"), F.desc("outliers"), "segment").limit(5).collect() if dimensions and x["outliers"] else []
    compared = [r for r in contrasts(df, name, others, low, high).collect() if r["ratio"]] if others and x["outliers"] else []
    compared.sort(key=lambda r: -max(abs(r["ratio"]), 1 / abs(r["ratio"])))
    readings = []
    if parts:
        readings.append(("segment", f"{parts[0]['column']} = {parts[0]['segment']} holds them at {parts[0]['rate']:.0%}"))
    if x["sentinel"]:
        readings.append(("sentinel", f"{x['sentinel'][0]:g} occurs {x['sentinel'][1]} times: perhaps it stands for no value"))
    if x["outliers"] and x["negative_out"] and x["negative"] < 0.1 * x["n"]:
        readings.append(("sign", "few values are negative: perhaps a sign was turned"))
    if x["outliers"] and x["round"] == x["outliers"] > 1:
        readings.append(("scale", "all are round: perhaps another unit"))
    if x["value_share"] >= 0.2:
        readings.append(("concentration", f"they carry {x['value_share']:.0%} of the value"))
    readings.append(("genuine", "they may be real: ask before removing them"))
    return {"low": low, "high": high, "iqr": iqr, **x, "records": records(df, name, low, high, iqr).collect(), "segments": parts, "contrasts": compared[:6], "readings": readings}


def questions(found: dict | None, name: str) -> list[str]:
    """What to ask whoever knows the data, from an investigation."""
    if found is None or not found["outliers"]:
        return [f"What would an unusual {name} look like?"]
    out = [f"Are values of {name} outside {found['low']:g} to {found['high']:g} possible at all?"]
    out += [f"What is special about {r['column']} = {r['segment']}?" for r in found["segments"][:2]]
    if found["sentinel"]:
        out.append(f"Does {found['sentinel'][0]:g} stand for a missing value?")
    return [*out, f"Should totals of {name} be read with or without them?"]
