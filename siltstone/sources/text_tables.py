"""Tables that lie in text: lines whose cells are parted by bars, tabs or wide gaps, document by document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.names import quoted

LEAST_ROWS = 2


def table_rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, table (number in the document), row (0: first line), cells (array) of runs of lines with as many cells each.

    Lines are split by array functions; a new table starts where the number of
    cells changes, found by one pass over a document's own lines.
    """
    lines = F.split(F.coalesce(F.col(quoted(text)), F.lit("")), "\n")
    bars = lambda l: F.regexp_replace(F.trim(l), r"^\||\|$", "")
    cut = lambda l: F.when(l.contains("|"), F.split(bars(l), r"\s*\|\s*", -1)).when(l.contains("\t"), F.split(l, "\t", -1)).otherwise(F.split(F.trim(l), r" {2,}", -1))
    rule = lambda l: l.rlike(r"^[\s|:+=-]*$")
    base = df.select(F.col(quoted(doc_id)).alias("doc_id"), F.filter(F.transform(lines, lambda l: F.when(~rule(l), F.transform(cut(l), lambda x: F.trim(x)))), lambda x: F.lit(True)).alias("l"))
    start = F.struct(F.lit(0).alias("table"), F.lit(0).alias("width"), F.lit(0).alias("row"), F.array().cast("array<struct<table:int,row:int,cells:array<string>>>").alias("out"))
    def step(acc, l):
        n = F.coalesce(F.size(l), F.lit(0))
        same = (n >= 2) & (n == acc["width"])
        table = F.when(same | (n < 2), acc["table"]).otherwise(acc["table"] + 1)
        row = F.when(same, acc["row"] + 1).otherwise(F.lit(0))
        width = F.when(l.isNull() & (acc["width"] > 0), acc["width"]).when(n < 2, F.lit(0)).otherwise(n)  # a rule between rows ends nothing
        keep = F.when(l.isNull(), acc["row"]).otherwise(row)
        return F.struct(table.alias("table"), width.alias("width"), keep.alias("row"), F.when(n >= 2, F.concat(acc["out"], F.array(F.struct(table.alias("table"), row.alias("row"), l.alias("cells"))))).otherwise(acc["out"]).alias("out"))
    found = base.select("doc_id", F.explode(F.aggregate("l", start, step)["out"]).alias("x")).select("doc_id", "x.*")
    sizes = found.groupBy("doc_id", "table").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    return found.join(sizes, ["doc_id", "table"], "left_semi").select("doc_id", "table", "row", "cells")


#: Lines that make a table, its header among them, and the share of them that must have its width.
LEAST_LINES = 3
REGULAR = 0.6
#: Share of a column's filled cells that must show numbers.
NUMERIC = 0.8
_RULE = re.compile(r"[\s|:+=-]*[-=][\s|:+=-]*")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def cell_number(text: str) -> float | None:
    """The number that a cell of a table shows; none for dates and for words that hold digits."""
    s = text.strip()
    sign = -1 if s.startswith("(") and s.endswith(")") else 1
    s = re.sub(r"[$€£¥₦,%\s]", "", s[1:-1] if sign < 0 else s)
    return sign * float(s) if _NUMBER.fullmatch(s) else None


def split_cells(line: str) -> list[str]:
    """Cells parted by bars, else by tabs, else by two blanks or more."""
    if "|" in line:
        line = line.strip()
        return [c.strip() for c in line.removeprefix("|").removesuffix("|").split("|")]
    return [c.strip() for c in (line.split("\t") if "\t" in line.strip() else re.split(r" {2,}", line.strip()))]


def _table(block: list[tuple[int, list[str]]]) -> dict | None:
    """The table of neighbouring lines of several cells, or None if they are too few or too ragged."""
    widths = Counter(len(c) for _, c in block)
    width = max(widths, key=lambda w: (widths[w], w == len(block[0][1])))
    regular = widths[width] / len(block)
    if len(block) < LEAST_LINES or regular < REGULAR:
        return None
    rows = [(c + [""] * width)[:width] for _, c in block]
    first, rest = rows[0], rows[1:]
    header = any(first) and not any(cell_number(c) is not None for c in first)
    repeated = sum(r == first for r in rest) if header else 0
    body = [r for r in rest if r != first] if header else rows
    names: list[str] = []
    for i, name in enumerate(first if header else [""] * width, 1):
        name, k = name or f"column_{i}", 2
        base = name
        while name in names:
            name, k = f"{base}_{k}", k + 1
        names.append(name)
    columns = [[r[i] for r in body if r[i]] for i in range(width)]
    kinds = ["number" if c and sum(cell_number(x) is not None for x in c) >= NUMERIC * len(c) else "text" for c in columns]
    filled = sum(map(len, columns)) / max(1, width * len(body))
    cells = [[None if not x else (f"{n:.15g}" if k == "number" and (n := cell_number(x)) is not None else x) for x, k in zip(r, kinds, strict=True)] for r in body]
    return {"start_line": block[0][0], "end_line": block[-1][0], "has_header": header, "columns": names, "types": kinds, "rows": cells, "repeated_headers": repeated, "confidence": round(regular * (0.5 + 0.5 * filled), 4)}


def read_text(text: str | None) -> tuple[list[dict], str]:
    """The tables of one text in order (lines are numbered from 1), and the text around them."""
    tables, prose, block, held = [], [], [], []
    for i, line in enumerate([*(text or "").split("\n"), ""], 1):
        cells = split_cells(line)
        if block and _RULE.fullmatch(line):
            held.append(line)
        elif len(cells) >= 2:
            block.append((i, cells))
            held.append(line)
        else:
            if block and (table := _table(block)):
                tables.append(table)
            else:
                prose += held
            block, held = [], []
            prose.append(line)
    return tables, "\n".join(prose[:-1])


_TABLES = "table int, start_line int, end_line int, has_header boolean, columns array<string>, types array<string>, rows array<array<string>>, repeated_headers int, confidence double"


def extract(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row for each table of each text: doc_id, its number, lines, header, column names and types, rows (numbers in plain form, blanks null), repeated headers that were dropped, confidence.

    Null and empty texts have none. Texts are read in Arrow batches and never shuffled.
    """
    kind = dict(df.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", *(c.split()[0] for c in _TABLES.split(", "))]
        for batch in batches:
            found = [(d, k, *t.values()) for d, x in zip(batch["doc_id"], batch["text"], strict=True) for k, t in enumerate(read_text(x)[0])]
            order = ["doc_id", "table", "start_line", "end_line", "has_header", "columns", "types", "rows", "repeated_headers", "confidence"]
            yield pd.DataFrame(found, columns=order)[names]

    return df.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")).mapInPandas(run, f"doc_id {kind}, {_TABLES}")


def prose(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text: every text without its tables."""
    rest = F.pandas_udf(lambda s: s.map(lambda t: read_text(t)[1]), "string")
    return df.select(F.col(quoted(doc_id)).alias("doc_id"), rest(F.col(quoted(text))).alias("text"))
