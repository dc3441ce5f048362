"""A neutral model of a dashboard: fields, measures, visuals on a page, slicers, and which of them rest on which, as plain data for any BI tool."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from siltstone.functions import names
from siltstone.operators import charts, kpi
from siltstone.operators.charts import Chart
from siltstone.plans.recipe import Dataset

# The page, the band of slicers, the gap between things, the height of a row of visuals, most slicers and their width.
PAGE, BAND, GAP, HEIGHT, SLICERS, SLICER_WIDTH = (1280, 720), 96, 12, 250, 4, 300
# What an aggregation is called in a label, in SQL, and in two formula languages.
WORDS = {"sum": ("Total", "SUM", "SUM", "SUM"), "avg": ("Average", "AVG", "AVERAGE", "AVG"), "min": ("Minimum", "MIN", "MIN", "MIN"), "max": ("Maximum", "MAX", "MAX", "MAX")}
TYPES = ("number", "date", "boolean")


@dataclass(frozen=True)
class Box:
    x: float
    y: float
    width: float
    height: float


@dataclass(frozen=True)
class Field:
    name: str
    caption: str
    type: str
    role: str


@dataclass(frozen=True)
class Measure:
    name: str
    column: str | None
    agg: str
    sql: str
    dax: str
    tableau: str


@dataclass(frozen=True)
class Visual:
    id: str
    title: str
    type: str
    x: str
    y: str | None
    series: str | None
    agg: str
    measure: str
    box: Box


@dataclass(frozen=True)
class Slicer:
    column: str
    caption: str
    values: tuple[str, ...]
    chosen: tuple[str, ...]
    box: Box


@dataclass(frozen=True)
class Model:
    name: str
    dataset: str
    table: str
    rows: int
    fields: tuple[Field, ...]
    measures: tuple[Measure, ...]
    visuals: tuple[Visual, ...]
    slicers: tuple[Slicer, ...]

    def edges(self) -> list[tuple[str, str]]:
        """What rests on what: measures on fields, visuals on measures and fields, slicers on fields."""
        out = [(f"measure:{m.name}", f"field:{m.column}") for m in self.measures if m.column]
        for v in self.visuals:
            out.append((f"visual:{v.id}", f"measure:{v.measure}"))
            out += [(f"visual:{v.id}", f"field:{c}") for c in (v.x, v.series) if c]
        return out + [(f"slicer:{s.column}", f"field:{s.column}") for s in self.slicers]

    def without(self, column: str) -> list[str]:
        """What a column's removal breaks, directly or through a measure."""
        lost, edges = [f"field:{column}"], self.edges()
        for at in lost:
            lost += [a for a, b in edges if b == at and a not in lost]
        return lost[1:]

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def safe_name(name: str) -> str:
    """A name for files and tables: letters, digits, hyphens and underscores, 60 at most."""
    bare = re.sub(r"\.[^/.]+$", "", name)
    return "_".join(re.sub(r"[^A-Za-z0-9 _-]+", " ", bare).split())[:60] or "Dashboard"


def measure(table: str, column: str | None, agg: str) -> Measure:
    """Rows where there is no column or they are counted; else the aggregation of the column."""
    if column is None or agg == "count":
        return Measure("Row Count", None, "count", "COUNT(*)", f"Row Count = COUNTROWS('{table}')", "COUNT([Number of Records])")
    word, sql, dax, tableau = WORDS[agg]
    name = f"{word} {names.title(column)}"
    return Measure(name, column, agg, f"{sql}({names.quoted(column)})", f"{name} = {dax}('{table}'[{column}])", f"{tableau}([{column}])")


def boxes(wide: list[bool], top: float) -> list[Box]:
    """Places of visuals in order, two in a row, wide ones in a row of their own."""
    whole = PAGE[0] - 2 * GAP
    half = (whole - GAP) / 2
    out, row, right = [], 0, False
    for w in wide:
        row += right and w
        right = right and not w
        out.append(Box(GAP + right * (half + GAP), top + row * (HEIGHT + GAP), whole if w else half, HEIGHT))
        row += w or right
        right = not w and not right
    return out


def _title(c: Chart) -> str:
    return f"{names.title(c.y)} by {names.title(c.x)}" if c.y else f"Rows by {names.title(c.x)}"


def build(ds: Dataset, chosen: dict[str, list[str]] | None = None, pinned: tuple[Chart, ...] = (), only: set[str] | None = None) -> Model:
    """From a dataset's profile and semantics: its dashboard's charts and pinned ones (or ``only`` those ids), slicers of its filters with what is ``chosen``.

    Only measures that a visual uses are in the model; one that counts rows if there is no visual.
    """
    p = ds.profile()
    s = kpi.read(p, ds.df)
    table, chosen = safe_name(ds.name), chosen or {}
    fields = tuple(Field(c.name, names.title(c.name), c.type if c.type in TYPES else "string", "measure" if c.type == "number" else "dimension") for c in p.columns)
    panels = [(f"panel_{k}", c) for k, c in enumerate(charts.dashboard(ds.df, p, s))] + [(f"pinned_{k}", c) for k, c in enumerate(pinned)]
    panels = [(i, c) for i, c in panels if only is None or i in only]
    found = list(charts.filters(ds.df, p, s).items())[:SLICERS]
    slicers = tuple(Slicer(c, names.title(c), tuple(v), tuple(chosen.get(c, ())), Box(GAP + k * (SLICER_WIDTH + GAP), GAP, SLICER_WIDTH, BAND - GAP)) for k, (c, v) in enumerate(found))
    places = boxes([c.type in ("line", "heatmap") for _, c in panels], BAND + GAP if slicers else GAP)
    measures = list(dict.fromkeys(measure(table, c.y, c.agg) for _, c in panels)) or [measure(table, None, "count")]
    visuals = tuple(Visual(i, _title(c), c.type, c.x, c.y, c.series, c.agg, measure(table, c.y, c.agg).name, box) for (i, c), box in zip(panels, places, strict=True))
    return Model(table, ds.name, table, p.rows, fields, tuple(measures), visuals, slicers)
