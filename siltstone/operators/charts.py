"""Which chart fits which columns, the series of a chart, and dashboards of panels."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators import aggregates as agg
from siltstone.operators.kpi import Semantics
from siltstone.operators.pivot import to_csv
from siltstone.operators.profile import Profile
from siltstone.operators.query import ROW, col

TYPES = ("bar", "line", "area", "pie", "doughnut", "scatter", "histogram", "heatmap")
CATEGORIES = 24
SLICES = 8
POINTS = 2000


@dataclass(frozen=True)
class Chart:
    type: str
    x: str
    y: str | None = None
    series: str | None = None
    agg: str = "sum"


def recommend(p: Profile, x: str, y: str | None = None, series: str | None = None) -> str:
    """The type that suits: time goes to a line, two numbers to a scatter, one to a histogram, two dimensions to a heatmap, few values to a doughnut."""
    c = p[x]
    if c.type == "date":
        return "line"
    if c.type == "number":
        return "scatter" if y and p[y].type == "number" else "histogram"
    if series:
        return "heatmap"
    return "doughnut" if c.unique <= 6 else "bar"


def why_not(p: Profile, chart: Chart) -> str | None:
    """The reason why a type does not suit its columns, or None."""
    c = p[chart.x]
    if chart.type in ("pie", "doughnut"):
        if c.unique > CATEGORIES:
            return "too many slices"
        if chart.y and (p[chart.y].min or 0) < 0:
            return "slices cannot be negative"
    if chart.type == "heatmap" and not chart.series:
        return "a heatmap needs a second dimension"
    if chart.type == "scatter" and not (c.type == "number" and chart.y and p[chart.y].type == "number"):
        return "a scatter needs two numbers"
    if chart.type == "histogram" and c.type != "number":
        return "a histogram needs a number"
    if chart.type in ("line", "area") and c.type not in ("date", "number", "category"):
        return "a line needs an order"
    return None


def compatible(p: Profile, chart: Chart) -> dict[str, str | None]:
    """Every type with the reason why it does not suit the chart's columns, or None."""
    return {t: why_not(p, replace(chart, type=t)) for t in TYPES}


def omitted_points(df: DataFrame, chart: Chart) -> int:
    """Pairs that a scatter of the first ``POINTS`` leaves out."""
    both = df.filter(agg.numeric(df, chart.x).isNotNull() & agg.numeric(df, chart.y).isNotNull())
    return max(0, both.count() - POINTS)


def series_lines(df: DataFrame, p: Profile, chart: Chart) -> list[list]:
    """The chart's data as a header and lines; a chart's series is small by its nature."""
    table = series(df, p, chart)
    return [table.columns, *map(list, table.collect())]


def charts_csv(df: DataFrame, p: Profile, charts: list[Chart]) -> str:
    """All charts as CSV, each under a line with its title."""
    return "\n".join(f"# {c.y or 'Rows'} by {c.x}\n" + to_csv(series_lines(df, p, c)) for c in charts)


def pinned_with(pins: list[Chart], chart: Chart) -> list[Chart]:
    """Pins with one more, if none is the same in all five fields."""
    return pins if chart in pins else [*pins, chart]


def toggled(chosen: dict[str, list[str]], name: str, value: str) -> dict[str, list[str]]:
    """A dashboard's choice after a click on a value: the click chooses it alone, a second one takes it back."""
    rest = {k: v for k, v in chosen.items() if k != name}
    return rest if chosen.get(name) == [value] else {**rest, name: [value]}


@dataclass(frozen=True)
class Board:
    """Key figures, charts by priority, and remarks in words."""

    figures: dict[str, float]
    charts: list[Chart]
    remarks: list[str]


# Measures, most charts and remarks of a board, and from what on a skew (%), a correlation and a move (%) are worth a remark.
BOARD_MEASURES, BOARD_CHARTS, REMARKS, SKEW, RELATED, MOVED = 2, 12, 6, 25, 0.6, 10


def board(df: DataFrame, p: Profile, s: Semantics) -> Board:
    """Key figures; the dashboard's charts and one for each further dimension; what is uneven, related or has moved.

    Rows, columns, the total of the two fullest and most varied measures with their mean and median, the first dimension's distinct values, health.
    """
    leading = sorted(s.measures, key=lambda m: (-p[m].completeness, -p[m].unique))[:BOARD_MEASURES]
    sums = df.agg(*(agg.sum_column(df, m).alias(str(k)) for k, m in enumerate(leading))).first() if leading else []
    figures = {"Rows": float(p.rows), "Columns": float(len(p.columns))}
    for m, total in zip(leading, sums, strict=True):
        figures |= {f"Total {m}": total, f"Average {m}": p[m].mean, f"Median {m}": p[m].median}
    if s.dimensions:
        figures[f"Distinct {s.dimensions[0]}"] = float(p[s.dimensions[0]].unique)
    figures["Health"] = float(p.health["overall"])
    charts = dashboard(df, p, s)
    charts += [c for d in s.dimensions for c in [Chart("bar", d, None, agg="count")] if c not in charts]
    remarks = []
    if s.measures and s.dimensions:
        remarks += pareto(agg.sum_by(df, s.dimensions[0], s.measures[0]), s.dimensions[0], s.measures[0])
    for c in [p[m] for m in s.measures[:3]]:
        if c.median and abs(c.mean - c.median) >= SKEW / 100 * abs(c.median):
            remarks.append(f"{c.name} is skewed: its mean is {abs(c.mean - c.median) / abs(c.median) * 100:.0f} % {'above' if c.mean > c.median else 'below'} its median.")
    if len(s.measures) > 1:
        remarks += [f"{r['a']} and {r['b']} are related (r = {r['r']:.2f})." for r in agg.correlations(df, s.measures[:4]).collect() if r["r"] is not None and abs(r["r"]) >= RELATED]
    if s.date and s.measures:
        last = agg.bucket_by_date(df, s.date, s.measures[0]).orderBy(F.desc("date")).limit(2).collect()
        if len(last) == 2 and last[1]["value"] and abs(move := (last[0]["value"] - last[1]["value"]) / abs(last[1]["value"]) * 100) >= MOVED:
            remarks.append(f"{s.measures[0]} {'rose' if move > 0 else 'fell'} by {abs(move):.1f} % in {last[0]['date']}.")
    return Board(figures, charts[:BOARD_CHARTS], remarks[:REMARKS])


def pareto(sums: DataFrame, dimension: str, measure: str, share: float = 0.8) -> list[str]:
    """How few segments hold four fifths of the measure, if that is at most half of them. One pass over segments, which are few."""
    parts = [r["value"] for r in sums.filter("value > 0").orderBy(F.desc("value")).collect()]
    total, held = sum(parts), 0.0
    for k, v in enumerate(parts, 1):
        held += v
        if held >= share * total:
            return [f"{k} of {len(parts)} values of {dimension} hold {100 * held / total:.0f} % of {measure}."] if len(parts) >= 3 and k <= len(parts) / 2 else []
    return []


def series(df: DataFrame, p: Profile, chart: Chart) -> DataFrame:
    """The chart's data as a small table."""
    if chart.type == "heatmap":
        return agg.cross_tab(df, chart.x, chart.series, chart.y)
    if chart.type == "histogram":
        return agg.histogram(df, chart.x)
    if chart.type == "scatter":
        pairs = df.select(ROW, agg.numeric(df, chart.x).alias("x"), agg.numeric(df, chart.y).alias("y")).filter("x is not null and y is not null")
        return pairs.orderBy(ROW).limit(POINTS).select("x", "y")
    if p[chart.x].type == "date":
        return agg.bucket_by_date(df, chart.x, chart.y, chart.agg if chart.y else "count").orderBy("date")
    counts = agg.aggregate_by(df, chart.x, chart.y, chart.agg, first=ROW in df.columns)
    return agg.top_with_other(counts, SLICES if chart.type in ("pie", "doughnut") else CATEGORIES)


def dashboard(df: DataFrame, p: Profile, s: Semantics) -> list[Chart]:
    """Up to eight panels: trend, driver, share, rank, second measure, distribution, relation, cross-tab, second trend."""
    m, d = s.measures, s.dimensions
    out: list[Chart] = []
    if s.date and m:
        out.append(Chart("line", s.date, m[0]))
    if d and m:
        out.append(Chart("bar", d[0], m[0]))
    if len(d) > 1:
        out.append(Chart("doughnut", d[1], m[0] if m else None, agg="sum" if m else "count"))
    if len(d) > 2 and m:
        out.append(Chart("bar", d[2], m[0]))
    if d and len(m) > 1:
        out.append(Chart("bar", d[0], m[1]))
    if m:
        out.append(Chart("histogram", m[0]))
    if len(m) > 1:
        best = max((r for r in agg.correlations(df, m[:6]).collect() if r["r"] is not None), key=lambda r: abs(r["r"]), default=None)
        if best and abs(best["r"]) >= 0.4:
            out.append(Chart("scatter", best["a"], best["b"]))
    if len(d) > 1 and all(p[x].unique <= 14 for x in d[:2]):
        out.append(Chart("heatmap", d[0], m[0] if m else None, d[1]))
    if s.date and len(m) > 1:
        out.append(Chart("line", s.date, m[1]))
    return out[:8]


def filters(df: DataFrame, p: Profile, s: Semantics) -> dict[str, list[str]]:
    """Up to three dimensions of 2 to 40 values with their values, commonest first."""
    out = {}
    for name in [x for x in s.dimensions if 2 <= p[x].unique <= 40][:3]:
        out[name] = [r["name"] for r in agg.value_counts(df, name).orderBy(F.desc("value"), "name").collect()]
    return out


def apply_filters(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Rows whose trimmed text is among the chosen ones, for every column with a choice."""
    for name, values in chosen.items():
        if values:
            df = df.filter(F.coalesce(cells.trim(col(name)), F.lit("")).isin(*values))
    return df
