"""Why values are missing: at random, by segment, or from a date on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.functions.stats import chi2_tail, cramers_v
from siltstone.operators.aggregates import when
from siltstone.operators.query import col

SEGMENT_ROWS = 15
SIGNIFICANT = 0.05
STRENGTH = 0.2
JUMP = 40.0


def two_way(df: DataFrame, target: str, candidates: list[str]) -> DataFrame:
    """column, segment, missing, present of every segment that is large enough, one aggregation."""
    gone = cells.is_blank(col(target))
    long = df.select(gone.alias("gone"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), cells.trim(col(c)).alias("segment")) for c in candidates))).alias("x")).select("gone", "x.*")
    counts = long.filter("segment != ''").groupBy("column", "segment").agg(F.count_if("gone").alias("missing"), F.count_if(~F.col("gone")).alias("present"))
    return counts.filter(F.col("missing") + F.col("present") >= SEGMENT_ROWS)


def chi_squared(counts: DataFrame) -> DataFrame:
    """column, n, segments, chi2 of the tables that :func:`two_way` gives."""
    w = W.partitionBy("column")
    n = F.col("missing") + F.col("present")
    t = counts.withColumns({"n": n, "all_n": F.sum(n).over(w), "all_missing": F.sum("missing").over(w), "all_present": F.sum("present").over(w)})
    em, ep = F.col("n") * F.col("all_missing") / F.col("all_n"), F.col("n") * F.col("all_present") / F.col("all_n")
    part = F.when(em > 0, (F.col("missing") - em) ** 2 / em).otherwise(0.0) + F.when(ep > 0, (F.col("present") - ep) ** 2 / ep).otherwise(0.0)
    return t.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("segments"), F.sum(part).alias("chi2")).filter("segments between 2 and 25")


def associations(df: DataFrame, target: str, candidates: list[str]) -> list[dict]:
    """Columns with whose segments missing cells go together, strongest first."""
    out = []
    for r in chi_squared(two_way(df, target, candidates)).collect() if candidates else []:
        p, v = chi2_tail(r["chi2"], r["segments"] - 1), cramers_v(r["chi2"], r["n"])
        if p < SIGNIFICANT and v >= STRENGTH:
            out.append({"column": r["column"], "chi2": r["chi2"], "p": p, "v": v})
    return sorted(out, key=lambda x: -x["v"])


def onset(df: DataFrame, target: str, date: str) -> DataFrame:
    """day, before, after, jump: share missing up to and from each day on, in percent; by cumulative sums over days, which are few."""
    days = df.select(F.date_format(when(df, date), "yyyy-MM-dd").alias("day"), cells.is_blank(col(target)).alias("gone")).filter("day is not null").groupBy("day").agg(F.count("*").alias("n"), F.count_if("gone").alias("m"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    total = W.partitionBy()
    sums = days.select("day", "n", "m", F.sum("n").over(w).alias("n0"), F.sum("m").over(w).alias("m0"), F.sum("n").over(total).alias("all_n"), F.sum("m").over(total).alias("all_m"))
    cut = sums.filter((F.col("n0") >= SEGMENT_ROWS) & (F.col("all_n") - F.col("n0") >= SEGMENT_ROWS))
    before, after = F.col("m0") / F.col("n0") * 100, (F.col("all_m") - F.col("m0")) / (F.col("all_n") - F.col("n0")) * 100
    return cut.select("day", before.alias("before"), after.alias("after"), (after - before).alias("jump"))


def mechanism(df: DataFrame, target: str, candidates: list[str], dates: list[str]) -> dict:
    """none (nothing missing), MAR (missing goes with another column), or MCAR; and the day with the largest jump."""
    n, gone = df.agg(F.count("*"), F.count_if(cells.is_blank(col(target)))).first()
    if not gone:
        return {"verdict": "none", "missing": 0, "rows": n, "associations": [], "timing": None}
    found = associations(df, target, [c for c in candidates if c != target])
    timing = None
    for d in dates:
        best = onset(df, target, d).orderBy(F.desc(F.abs("jump")), "day").first()
        if best and abs(best["jump"]) >= JUMP and (timing is None or abs(best["jump"]) > abs(timing["jump"])):
            timing = {"column": d, **best.asDict()}
    return {"verdict": "MAR" if found else "MCAR", "missing": gone, "rows": n, "associations": found, "timing": timing, "hypothesis": f"whether {target} is missing may also depend on its own value (MNAR), which the table cannot show"}


def questions(found: dict, name: str) -> list[str]:
    """What to ask about missing cells, from :func:`mechanism`."""
    if found["verdict"] == "none":
        return []
    out = [f"Who leaves {name} blank where {a['column']} differs?" for a in found["associations"][:2]]
    if found["timing"]:
        out.append(f"What changed on {found['timing']['day']}?")
    return [*out, f"Could {name} be blank because of the value it would have?"]
