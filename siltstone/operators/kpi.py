"""What columns mean, and key figures with the windows that they are compared over.

All figures of all windows come from one aggregation with conditional sums.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells, names
from siltstone.operators.aggregates import numeric, when
from siltstone.operators.profile import ColumnProfile, Profile
from siltstone.operators.query import col

MOST = 6


@dataclass(frozen=True)
class Semantics:
    """Measures and dimensions, best first, by role and in all, and the date that anchors periods."""

    measures: list[str]
    dimensions: list[str]
    roles: dict[str, str]
    date: str | None
    currency: str | None = None


def measure_columns(p: Profile) -> list[ColumnProfile]:
    return [c for c in p.columns if c.type == "number" and not names.is_identifier(c.name) and not c.is_index]


def dimension_columns(p: Profile) -> list[ColumnProfile]:
    def fits(c: ColumnProfile) -> bool:
        if c.type in ("category", "boolean"):
            return c.unique >= 2
        return c.type == "string" and 2 <= c.unique <= 25 and c.unique <= 0.5 * c.filled and not names.is_identifier(c.name)

    return [c for c in p.columns if fits(c)]


def currency_sign(df: DataFrame, name: str, row: str = "_rid") -> str | None:
    """The one currency sign that at least three of the first 400 texts begin with."""
    if dict(df.dtypes)[name] != "string":
        return None
    first = df.filter(col(name).isNotNull()).orderBy(row).limit(400).select(F.regexp_extract(cells.trim(col(name)), r"^(?:-|\()?\s*([$€£¥₦₹])", 1).alias("s"))
    found = first.filter("s != ''").groupBy("s").count().collect()
    return found[0]["s"] if len(found) == 1 and found[0]["count"] >= 3 else None


def read(p: Profile, df: DataFrame | None = None) -> Semantics:
    measures = sorted(measure_columns(p), key=lambda c: (-c.completeness, -c.unique))
    dimensions = sorted(dimension_columns(p), key=lambda c: (not 2 <= c.unique <= 12, c.unique))
    roles: dict[str, str] = {}
    for c in measures:
        if (r := names.role_of(c.name)) in names.MEASURE_ROLES:
            roles.setdefault(r, c.name)
    for c in p.columns:
        r = names.role_of(c.name)
        if c.type != "date" and r and r not in names.MEASURE_ROLES:
            roles.setdefault(r, c.name)
    dates = [c for c in p.columns if c.type == "date"]
    date = next((c for c in dates if c.date_min != c.date_max), dates[0] if dates else None)
    money = roles.get("revenue") or roles.get("profit") or roles.get("cost")
    return Semantics([c.name for c in measures], [c.name for c in dimensions], roles, date.name if date else None, currency_sign(df, money) if df is not None and money else None)


@dataclass(frozen=True)
class Windows:
    """Two equal spans of time up to the last date: (from, to] each."""

    days: int
    last: dt.datetime

    def flags(self, t: Column) -> tuple[Column, Column]:
        end = F.lit(self.last)
        mid, start = F.lit(self.last - dt.timedelta(days=self.days)), F.lit(self.last - dt.timedelta(days=2 * self.days))
        return (t > mid) & (t <= end), (t > start) & (t <= mid)


def windows(df: DataFrame, date: str) -> Windows | None:
    """By the span of the dates: a year, a month, a week or a day each; none if the span is under two windows or two days."""
    low, high, n = df.select(when(df, date).alias("t")).agg(F.min("t"), F.max("t"), F.count("t")).first()
    if n < 4:
        return None
    span = (high - low).total_seconds() / 86400
    days = 365 if span > 730 else 30 if span > 92 else 7 if span > 14 else 1
    return Windows(days, high) if span >= 2 and span >= 2 * days else None


@dataclass(frozen=True)
class Kpi:
    id: str
    label: str
    format: str
    value: float
    previous: float | None = None
    delta: float | None = None
    higher_is_better: bool = True


def catalogue(df: DataFrame, p: Profile, s: Semantics) -> list[tuple[str, str, str, object]]:
    """Candidates (id, label, format, figure): a figure makes a Column from a condition on rows."""
    out: list[tuple[str, str, str, object]] = []
    used: set[str] = set()
    r = s.roles

    def total(name: str):
        used.add(name)
        return lambda on: F.coalesce(F.sum(F.when(on.rows, numeric(df, name))), F.lit(0.0))

    def distinct(name: str, also=None):
        return lambda on: on.distinct(name, also)

    revenue, profit, cost, quantity = r.get("revenue"), r.get("profit"), r.get("cost"), r.get("quantity")
    price, customer, order = r.get("unitPrice"), r.get("customer"), r.get("order")
    if revenue:
        out.append(("revenue", f"Total {names.title(revenue)}", "currency", total(revenue)))
    if profit:
        out.append(("profit", f"Total {names.title(profit)}", "currency", total(profit)))
    elif revenue and cost:
        out.append(("derived_profit", "Gross Profit", "currency", lambda on: total(revenue)(on) - total(cost)(on)))
    if revenue and (profit or cost):
        gain = (lambda on: total(profit)(on)) if profit else (lambda on: total(revenue)(on) - total(cost)(on))
        out.append(("margin", "Profit Margin", "percent", lambda on: F.try_divide(gain(on) * 100, total(revenue)(on))))
    if order:
        out.append(("orders", names.plural(names.title(order, True)), "integer", distinct(order)))
    if customer:
        out.append(("customers", names.plural(names.title(customer, True)), "integer", distinct(customer)))
    if revenue:
        units = distinct(order) if order else (lambda on: F.count_if(on.rows).cast("double"))
        out.append(("aov", "Average Order Value", "currency", lambda on: F.try_divide(total(revenue)(on), units(on))))
    if quantity:
        stock = re.search(r"\b(stock|inventory|on hand)\b", names.spaced(quantity))
        out.append(("quantity", f"Total {names.title(quantity)}" if stock else "Units Sold", "number", total(quantity)))
        if stock and price:
            out.append(("inventory_value", "Inventory Value", "currency", lambda on: F.coalesce(F.sum(F.when(on.rows, numeric(df, quantity) * numeric(df, price))), F.lit(0.0))))
    status, flag = r.get("status"), r.get("flag")
    outcome = status or flag
    if outcome and p[outcome].unique <= 12:
        hit = cells.is_won(col(outcome)) if status else cells.is_truthy(col(outcome))
        known = ~cells.is_blank(col(outcome))
        out.append(("conversion", "Conversion Rate" if status else f"{names.title(outcome)} Rate", "percent", lambda on: F.when(F.count_if(on.rows & hit) > 0, F.count_if(on.rows & hit) * 100.0 / F.count_if(on.rows & known))))
        if customer and not status:
            out.append(("active_users", f"Active {names.plural(names.title(customer, True))}", "integer", lambda on: F.when(F.count_if(on.rows & hit) > 0, distinct(customer, hit)(on))))
    if cost:
        out.append(("cost", f"Total {names.title(cost)}", "currency", total(cost)))
    for m in s.measures[:3]:
        if m not in {revenue, profit, cost, quantity} - {None}:
            out.append((f"total_{m}", f"Total {names.title(m)}", "number", total(m)))
            out.append((f"avg_{m}", f"Average {names.title(m)}", "number", lambda on, m=m: F.avg(F.when(on.rows, numeric(df, m)))))
    for d in s.dimensions[:2]:
        out.append((f"distinct_{d}", f"Distinct {names.title(d)}", "integer", distinct(d)))
    return out


class On:
    """A condition on rows, and the distinct counts under it: asked for at first, known later."""

    def __init__(self, rows: Column, known: dict | None = None):
        self.rows, self.known, self.asked = rows, known, []

    def distinct(self, name: str, also: Column | None) -> Column:
        key = (name, None if also is None else str(also))
        self.asked.append((key, name, also))
        return F.lit(None if self.known is None else float(self.known[key]))


def distinct_counts(df: DataFrame, wanted: list[tuple[str, Column | None]], conditions: list[Column]) -> list[list[int]]:
    """For each (column, further condition or none) the distinct values, trimmed and not blank, under each condition.

    One shuffle: every row gives each column's value, by two hashes, and the conditions that it meets as bits; a value's
    bits are merged in each task and then over all, and counted. No row is copied for each count, as several distinct aggregates do.
    """
    places: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(wanted):
        places.setdefault(name, []).append(k)

    def bits(ks: list[int]) -> Column:
        out = F.lit(0).cast("long")
        for i, k in enumerate(ks):
            for j, on in enumerate(conditions):
                met = on if wanted[k][1] is None else on & wanted[k][1]
                out = out.bitwiseOR(F.when(met, F.lit(1 << (i * len(conditions) + j)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    def cell(at: int, name: str) -> Column:
        key = F.nullif(cells.trim(col(name)), F.lit(""))
        return F.when(key.isNotNull(), F.struct(F.lit(at).alias("at"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), bits(places[name]).alias("bits")))

    rows = df.select(F.explode(F.array(*(cell(i, n) for i, n in enumerate(places)))).alias("x")).filter("x is not null").select("x.*")
    values = rows.groupBy("at", "h1", "h2").agg(F.bit_or("bits").alias("bits"))
    most = max(map(len, places.values())) * len(conditions)
    counts = {r["at"]: r for r in values.groupBy("at").agg(*(F.count_if(F.col("bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0).alias(f"b{k}") for k in range(most))).collect()}
    out: list[list[int]] = [[] for _ in wanted]
    for at, ks in enumerate(places.values()):
        for i, k in enumerate(ks):
            out[k] = [counts[at][f"b{i * len(conditions) + j}"] if at in counts else 0 for j in range(len(conditions))]
    return out


def figures(df: DataFrame, candidates: list[tuple], spans: Windows | None, date: str | None) -> dict[str, tuple]:
    """(all, current, previous) of each candidate: one pass, and one shuffle of hashes for all distinct counts."""
    if not candidates:
        return {}
    now, before = spans.flags(when(df, date)) if spans else (F.lit(False), F.lit(False))
    conditions = [F.lit(True), now, before]
    asking = On(conditions[0])
    for _, _, _, figure in candidates:
        figure(asking)
    wanted = {key: (name, also) for key, name, also in asking.asked}
    found = distinct_counts(df, list(wanted.values()), conditions) if wanted else []
    under = [On(c, {key: found[k][j] for k, key in enumerate(wanted)}) for j, c in enumerate(conditions)]
    got = df.agg(*(F.struct(*(figure(on) for on in under)).alias(str(i)) for i, (_, _, _, figure) in enumerate(candidates))).first()
    return {c[0]: tuple(got[i]) for i, c in enumerate(candidates)}


def kpis(df: DataFrame, p: Profile, s: Semantics | None = None, most: int = MOST) -> list[Kpi]:
    """The first figures, of labels of their own, that have a value; compared where the window before has one that is not 0."""
    s = s or read(p, df)
    spans = windows(df, s.date) if s.date else None
    candidates = catalogue(df, p, s)
    values = figures(df, candidates, spans, s.date)
    out: list[Kpi] = []
    for ident, label, form, _ in candidates:
        whole, now, before = values[ident]
        if whole is None or label in {k.label for k in out}:
            continue
        change = (now - before) / abs(before) * 100 if spans and before and now is not None else None
        out.append(Kpi(ident, label, form, now if change is not None else whole, before if change is not None else None, change, ident != "cost"))
        if len(out) == most:
            break
    return out
