"""Recurring files: fingerprints of schemas, and what changed from one period to the next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.names import matching_key
from siltstone.functions.stats import nearest
from siltstone.operators.aggregates import numeric
from siltstone.operators.profile import Profile
from siltstone.operators.query import col

RECURRING = 70
MOST_VALUES = 200


@dataclass(frozen=True)
class Fingerprint:
    """Matching keys of the columns with their types."""

    types: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, p: Profile) -> Fingerprint:
        return cls(tuple(sorted((matching_key(c.name), c.type) for c in p.columns)))

    @property
    def key(self) -> str:
        return "|".join(f"{n}:{t}" for n, t in self.types)


def similarity(a: Fingerprint, b: Fingerprint, dropped: frozenset[str] = frozenset()) -> int:
    """0 to 100: share of names in both, worth up to a third less where types differ; names that the recipe drops do not count."""
    x, y = ({n: t for n, t in f.types if n not in dropped} for f in (a, b))
    shared, union = x.keys() & y.keys(), x.keys() | y.keys()
    if not shared:
        return 0
    agree = sum(x[n] == y[n] for n in shared) / len(shared)
    return nearest(100 * len(shared) / len(union) * (0.65 + 0.35 * agree))


def recurring(new: Fingerprint, known: list[tuple[str, Fingerprint, float, frozenset[str]]]) -> str | None:
    """Of (name, fingerprint, time saved, columns that its recipe drops) the best match that is good enough, the newest of equal ones."""
    best = max(((similarity(f, new, dropped), at, name) for name, f, at, dropped in known), default=None)
    return best[2] if best and best[0] >= RECURRING else None


def numeric_changes(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """column, total and mean of both periods, change of the total in percent."""
    def sums(df: DataFrame, tag: str) -> DataFrame:
        one = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.sum(numeric(df, c)).alias("total"), F.avg(numeric(df, c)).alias("mean")) for c in columns)).alias("x"))
        return one.select(F.explode("x").alias("x")).select("x.column", F.col("x.total").alias(f"total_{tag}"), F.col("x.mean").alias(f"mean_{tag}"))

    both = sums(before, "before").join(sums(after, "after"), "column")
    return both.withColumn("change", F.when(F.col("total_before") != 0, (F.col("total_after") - F.col("total_before")) / F.abs("total_before") * 100))


def value_changes(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """value, change (appeared or disappeared) of a category; texts as they are, nulls and empty ones left out."""
    a, b = (df.select(col(column).cast("string").alias("value")).filter("value != ''").distinct() for df in (before, after))
    return b.join(a, "value", "left_anti").select("value", F.lit("appeared").alias("change")).unionByName(a.join(b, "value", "left_anti").select("value", F.lit("disappeared").alias("change")))


def diff(before: DataFrame, after: DataFrame, p: Profile, q: Profile) -> dict:
    """Rows, health, columns added, removed and retyped, completeness moves over 2 points, totals, and category values."""
    x, y = {c.name: c for c in p.columns}, {c.name: c for c in q.columns}
    shared = [n for n in x if n in y]
    nums = [n for n in shared if x[n].type == y[n].type == "number" and not y[n].is_index]
    cats = [n for n in shared if x[n].type in ("category", "string") and y[n].type in ("category", "string") and max(x[n].unique, y[n].unique) <= MOST_VALUES]
    totals = [r.asDict() for r in numeric_changes(before, after, nums).collect()] if nums else []
    moves = {}
    for n in cats:
        rows = value_changes(before, after, n).orderBy("value").collect()
        if rows:
            moves[n] = {k: [r["value"] for r in rows if r["change"] == k] for k in ("appeared", "disappeared")}
    return {
        "rows": (p.rows, q.rows), "health": (p.health["overall"], q.health["overall"]),
        "added": [n for n in y if n not in x], "removed": [n for n in x if n not in y], "retyped": [n for n in shared if x[n].type != y[n].type],
        "completeness": {n: (x[n].completeness, y[n].completeness) for n in shared if abs(x[n].completeness - y[n].completeness) > 2},
        "numbers": sorted(totals, key=lambda r: -abs(r["change"] or 0)), "categories": moves,
    }


def narrative(d: dict) -> list[str]:
    """The difference in sentences: schema, rows, numbers, completeness, categories, health."""
    out = []
    for what in ("added", "removed", "retyped"):
        if d[what]:
            out.append(f"Columns {what}: {', '.join(d[what])}.")
    a, b = d["rows"]
    out.append(f"Rows went from {a} to {b}." if a != b else f"Both periods have {a} rows.")
    for r in d["numbers"][:5]:
        if r["change"]:
            out.append(f"{r['column']} {'rose' if r['change'] > 0 else 'fell'} by {abs(r['change']):.2f} % to {r['total_after']:g}.")
    out += [f"{n} is filled to {v:g} % after {u:g} %." for n, (u, v) in d["completeness"].items()]
    for n, m in d["categories"].items():
        out += [f"{n}: {', '.join(v)} {k}." for k, v in m.items() if v]
    if d["health"][0] != d["health"][1]:
        out.append(f"Health went from {d['health'][0]} to {d['health'][1]}.")
    return out


def close(new: DataFrame, name: str, known: list[tuple[str, Fingerprint, float, frozenset[str]]], recipes: dict[str, list[tuple]], last: dict[str, DataFrame]) -> dict:
    """A period's close: find the file's kind, replay its recipe, and tell what differs from the last period.

    Without a match the file is only profiled. ``known`` is as for :func:`recurring`.
    """
    from siltstone.operators.profile import profile
    from siltstone.plans.recipe import replay

    match = recurring(Fingerprint.of(profile(new)), known)
    if match is None:
        return {"name": name, "match": None, "df": new, "applied": [], "skipped": [], "changes": []}
    df, applied, skipped = replay(new, recipes.get(match, []))
    before = last.get(match)
    changes = narrative(diff(before, df, profile(before), profile(df))) if before is not None else []
    return {"name": name, "match": match, "df": df, "applied": applied, "skipped": skipped, "changes": changes}
