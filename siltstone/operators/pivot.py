"""Pivot tables with totals of the source rows, by grouping sets in one pass."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators.aggregates import numeric
from siltstone.operators.query import col

TOTAL = "Total"
OTHER = "Other"


@dataclass(frozen=True)
class Pivot:
    """What goes on rows, columns and values: values are (measure or None, sum | avg | count | min | max)."""

    rows: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    values: tuple[tuple[str | None, str], ...] = ((None, "count"),)
    filters: tuple[tuple[str, tuple[str, ...]], ...] = ()
    limit: int | None = None
    labels: dict = field(default_factory=dict, compare=False)

    def value_label(self, k: int) -> str:
        measure, kind = self.values[k]
        if measure is None:
            return "Count of rows"
        return {"sum": "Sum of ", "avg": "Average of ", "count": "Count of ", "min": "Min of ", "max": "Max of "}[kind] + measure


def _kept(df: DataFrame, spec: Pivot) -> DataFrame:
    """Rows that the filters let through and that have no blank key."""
    for name, allowed in spec.filters:
        if allowed:
            df = df.filter(F.coalesce(cells.trim(col(name)), F.lit("")).isin(*allowed))
    for name in (*spec.rows, *spec.columns):
        df = df.filter(~cells.is_blank(col(name)))
    return df


def _path(names: tuple[str, ...]) -> Column:
    return F.array(*(cells.trim(col(n)) for n in names)) if names else F.array(F.lit(TOTAL))


def _value(df: DataFrame, measure: str | None, kind: str) -> Column:
    if measure is None:
        return F.count("*").cast("double")
    n = numeric(df, measure)
    return {"sum": F.sum(n), "avg": F.avg(n), "count": F.count("*").cast("double"), "min": F.min(n), "max": F.max(n)}[kind]


def top_rows(df: DataFrame, spec: Pivot) -> DataFrame:
    """Row paths that stay by themselves under the limit: by the first value's total, ties by path."""
    measure, kind = spec.values[0]
    totals = _kept(df, spec).groupBy(_path(spec.rows).alias("r")).agg(_value(df, measure, kind).alias("v"))
    return totals.orderBy(F.desc_nulls_last("v"), "r").limit(spec.limit).select("r")


def pivot(df: DataFrame, spec: Pivot) -> DataFrame:
    """row_path, col_path (arrays; null for a total), is_other, v0, v1, ...; what the limit leaves out is under Other, where is_other tells it from a value of that name."""
    rows = _kept(df, spec).withColumns({"__r": _path(spec.rows), "__c": _path(spec.columns)})
    if spec.limit is not None:
        top = F.broadcast(top_rows(df, spec).withColumn("__top", F.lit(True)))  # ``limit`` rows
        rows = rows.join(top, rows["__r"] == top["r"], "left").withColumn("__r", F.when(F.col("__top"), F.col("__r")).otherwise(F.array(F.lit(OTHER))))
    rows = rows.withColumn("is_other", F.col("__top").isNull() if spec.limit is not None else F.lit(False))
    values = [_value(df, m, k).alias(f"v{i}") for i, (m, k) in enumerate(spec.values)]
    r, o, c = F.col("__r"), F.col("is_other"), F.col("__c")
    out = rows.groupingSets([[r, o, c], [r, o], [c], []], r, o, c).agg(*values)
    return out.select(r.alias("row_path"), c.alias("col_path"), F.coalesce(o, F.lit(False)).alias("is_other"), *(f"v{i}" for i in range(len(values))))


def matched_rows(df: DataFrame, spec: Pivot) -> int:
    return _kept(df, spec).count()


def drill(df: DataFrame, spec: Pivot, row_path: list[str] | None = None, col_path: list[str] | None = None, is_other: bool | None = None) -> DataFrame:
    """Source rows behind a cell, a row, a column or all; Other is every row that the limit leaves out, unless ``is_other`` says that a value of that name is meant."""
    rows = _kept(df, spec)
    if spec.limit is not None and (row_path == [OTHER] if is_other is None else is_other):
        top = F.broadcast(top_rows(df, spec))
        rows = rows.withColumn("__r", _path(spec.rows)).join(top, F.col("__r") == F.col("r"), "left_anti").drop("__r")
    elif row_path is not None and spec.rows:
        rows = rows.filter(_path(spec.rows) == F.array(*map(F.lit, row_path)))
    if col_path is not None and spec.columns:
        rows = rows.filter(_path(spec.columns) == F.array(*map(F.lit, col_path)))
    return rows


#: Paths on either side of a grid that is laid out for reading.
GRID = 2000


def default_layout(dimensions: list[str], dates: list[str], measures: list[str]) -> Pivot:
    """The first dimension (else date) on rows and the sum of the first measure, or counts of rows without one."""
    return Pivot(tuple([*dimensions, *dates][:1]), (), (((measures[0], "sum") if measures else (None, "count")),))


def matrix(cells_: DataFrame, spec: Pivot, most: int = GRID) -> list[list]:
    """The pivot as a rectangle: header lines, a line for each row path, and the Total line, which ends in the grand total.

    Row and column paths are in order, Other last. A layout of over ``most`` paths
    on a side is an error: such a grid is for ``pivot`` itself to write.
    """
    found = cells_.limit((most + 2) ** 2 + 1).collect()
    columns = sorted({tuple(r["col_path"]) for r in found if r["col_path"] is not None}) if spec.columns else []
    rows = sorted({(r["is_other"], tuple(r["row_path"])) for r in found if r["row_path"] is not None})
    if max(len(rows), len(columns)) > most:
        raise ValueError(f"more than {most} rows or columns")
    value = {((r["is_other"], tuple(r["row_path"])) if r["row_path"] is not None else None, tuple(r["col_path"]) if spec.columns and r["col_path"] is not None else None): r for r in found}
    n, lead = len(spec.values), max(1, len(spec.rows))
    slots = [*columns, None]  # the last one is the row's total

    def line(head: list, key) -> list:
        got = [value.get((key, c)) for c in slots]
        return [*head, *(None if r is None else r[f"v{i}"] for r in got for i in range(n))]

    out = []
    for k in range(len(spec.columns)):
        label = [spec.columns[k], *[""] * (lead - 1)]
        out.append([*label, *(("Total" if k == 0 else "") if c is None else c[k] for c in slots for _ in range(n))])
    if n > 1 or not spec.columns:
        out.append([*(spec.rows or ("",)), *(spec.value_label(i) for _ in slots for i in range(n))])
    out += [line([*r[1], *[""] * (lead - len(r[1]))], r) for r in rows] if spec.rows else []
    return [*out, line([TOTAL, *[""] * (lead - 1)], None)]


def to_csv(lines: list[list]) -> str:
    """Lines as CSV: quotes where a text has a comma, a quote or a line's end; null is empty."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["" if x is None else int(x) if isinstance(x, float) and x.is_integer() else x for x in line] for line in lines])
    return out.getvalue()


def header_runs(paths: list[tuple[str, ...]], level: int) -> list[tuple[str, int]]:
    """Labels of one header level with how many neighbours they span: those of one parent path."""
    return [(key[-1], len(list(run))) for key, run in groupby(paths, key=lambda p: p[: level + 1])]


def repeats_parent(paths: list[tuple[str, ...]], at: int, level: int) -> bool:
    """Whether a row shows the same path up to ``level`` as the row above it."""
    return at > 0 and paths[at][: level + 1] == paths[at - 1][: level + 1]
