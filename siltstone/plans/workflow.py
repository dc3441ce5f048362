"""Workflows (cleaning and charts together), recipe books, search over names, and answers from a profile."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.charts import Chart
from siltstone.operators.profile import Profile
from siltstone.plans import recipe


@dataclass(frozen=True)
class Workflow:
    """Steps in order: cleaning operations (tuples) and charts."""

    name: str
    steps: tuple[tuple | Chart, ...] = ()

    @property
    def ops(self) -> list[tuple]:
        return [s for s in self.steps if not isinstance(s, Chart)]

    @property
    def charts(self) -> list[Chart]:
        return [s for s in self.steps if isinstance(s, Chart)]

    def summary(self) -> str:
        return f"{self.name}: {len(self.ops)} cleaning steps, {len(self.charts)} charts"

    @classmethod
    def capture(cls, ds: recipe.Dataset, charts: tuple[Chart, ...] = (), name: str | None = None) -> Workflow:
        """What has been done to a dataset, then its charts."""
        return cls(name or f"{ds.name} workflow", (*ds.ops, *charts))

    def described(self) -> list[str]:
        """A line for each step."""
        return [recipe.describe_op(s) if not isinstance(s, Chart) else f"Chart: {s.type} of {s.y or 'rows'} by {s.x}" for s in self.steps]

    def columns(self) -> list[str]:
        """Columns that the steps name, in order, each once."""
        named = [[s.x, s.y, s.series] if isinstance(s, Chart) else [recipe.clean.needs(s)] for s in self.steps]
        return list(dict.fromkeys(n for part in named for n in part if n))

    def moved(self, at: int, to: int) -> Workflow:
        """A step to another place; places outside change nothing."""
        if not (0 <= at < len(self.steps) and 0 <= to < len(self.steps)):
            return self
        steps = [*self.steps[:at], *self.steps[at + 1 :]]
        return replace(self, steps=(*steps[:to], self.steps[at], *steps[to:]))

    def removed(self, at: int) -> Workflow:
        return replace(self, steps=tuple(s for i, s in enumerate(self.steps) if i != at))

    def apply(self, df: DataFrame) -> tuple[DataFrame, list[Chart], list[tuple | Chart]]:
        """The cleaned frame, the charts whose columns it has, and the steps that were skipped."""
        out, _, skipped = recipe.replay(df, self.ops)
        kept = [c for c in self.charts if all(n in out.columns for n in (c.x, c.y, c.series) if n)]
        return out, kept, [*skipped, *(c for c in self.charts if c not in kept)]

    def to_json(self) -> str:
        return json.dumps({"version": recipe.VERSION, "name": self.name, "steps": [{"chart": asdict(s)} if isinstance(s, Chart) else {"clean": list(s)} for s in self.steps]})

    @classmethod
    def from_json(cls, text: str) -> Workflow:
        try:
            data = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError("this is no JSON") from e
        if not isinstance(data, dict) or data.get("version") != recipe.VERSION or not isinstance(data.get("steps"), list):
            raise ValueError("this is no workflow of a known version")
        steps: list[tuple | Chart] = []
        for s in data["steps"]:
            if isinstance(s, dict) and "chart" in s:
                steps.append(Chart(**s["chart"]))
            elif isinstance(s, dict) and s.get("clean"):
                steps.append(tuple(s["clean"]))
            else:
                raise ValueError("a step is neither a chart nor a cleaning step")
        return cls(str(data.get("name", "")), tuple(steps))


def newest(rows: DataFrame, key: str, at: str, *tie: str) -> DataFrame:
    """Of rows with one key the newest, as a recipe book keeps them; ties by further columns. One aggregation, no sort."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(at, *tie))
    return rows.groupBy(key).agg(best.alias("__r")).select(key, "__r.*")


# What a match of each kind is worth.
EXACT, PREFIX, WORD_START, WITHIN, KEYWORD, SUBSEQUENCE = 1000, 800, 600, 400, 250, 100
KIND_WEIGHTS = {"page": 30, "dataset": 20, "chart": 10}


def match_score(label: Column, text: str, keywords: Column | None = None) -> Column:
    """How well a label, or else its keywords, matches what was typed; null if not at all."""
    low, wanted = F.lower(label), text.strip().lower()
    letters = ".*".join(map(re.escape, wanted.replace(" ", "")))
    return (
        F.when(low == wanted, EXACT).when(low.startswith(wanted), PREFIX).when(low.rlike(rf"\b\Q{wanted}\E"), WORD_START).when(F.contains(low, F.lit(wanted)), WITHIN).when(F.coalesce(F.contains(F.lower(keywords), F.lit(wanted)), F.lit(False)) if keywords is not None else F.lit(False), KEYWORD).when(low.rlike(letters), SUBSEQUENCE)
    )


def search(labels: DataFrame, column: str, text: str, most: int = 20) -> DataFrame:
    """Labels that match, best first, shorter before longer ones."""
    scored = labels.select(F.col(column).alias("label"), match_score(F.col(column), text).alias("score")).filter("score is not null")
    return scored.distinct().orderBy(F.desc("score"), F.length("label"), "label").limit(most)


def find(things: DataFrame, text: str, most: int = 20) -> DataFrame:
    """Of things (label, kind, keywords) those that match, with their score and their kind's weight, best first."""
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair)), F.col("kind")), F.lit(0))
    scored = things.withColumn("score", match_score(F.col("label"), text, F.col("keywords")) + weight).filter("score is not null")
    return scored.orderBy(F.desc("score"), F.length("label"), "label").limit(most).select("label", "kind", "score")


def answer(p: Profile, question: str) -> str:
    """A sentence from the profile for questions about size, duplicates, gaps, health, or a column by name."""
    low = question.lower()
    named = max((c for c in p.columns if c.name and c.name.lower() in low), key=lambda c: len(c.name), default=None)
    if named:
        more = f", from {named.min:g} to {named.max:g}, mean {named.mean:g}" if named.mean is not None else ""
        return f"{named.name} is a {named.type}, filled to {named.completeness:g} %, with {named.unique} distinct values{more}."
    if re.search(r"duplicat|repeat", low):
        return f"{p.duplicates} rows repeat an earlier one."
    if re.search(r"missing|null|blank|empty|gap", low):
        gaps = [f"{c.name} ({c.missing})" for c in p.columns if c.missing]
        return "Blank cells: " + ", ".join(gaps) + "." if gaps else "No cell is blank."
    if re.search(r"health|quality|score", low):
        return f"The health score is {p.health['overall']} of 100."
    if re.search(r"column|field", low):
        return "Columns: " + ", ".join(c.name for c in p.columns) + "."
    if re.search(r"how many|rows|size|large|big", low):
        return f"{p.rows} rows and {len(p.columns)} columns."
    return "Ask about size, columns, duplicates, blank cells, health, or a column by its name."
