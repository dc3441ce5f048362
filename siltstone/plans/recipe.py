"""Recipes: cleaning operations kept as JSON, replayed on a new file, previewed, undone."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators import clean, joins
from siltstone.operators.profile import Profile, data_columns, profile
from siltstone.operators.query import ROW, with_rows
from siltstone.sources import files

VERSION = 1
UNDO = 10


def to_json(source: str, ops: list[tuple]) -> str:
    return json.dumps({"version": VERSION, "source": source, "ops": [list(op) for op in ops]})


def from_json(text: str) -> tuple[str, list[tuple]]:
    """Source and operations; ValueError says which of the three ways of being wrong it is."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError("this is no JSON") from e
    if not isinstance(data, dict) or data.get("version") != VERSION:
        raise ValueError("this is no recipe of a known version")
    ops = [tuple(op) for op in data.get("ops", []) if isinstance(op, list) and op]
    if unknown := [op[0] for op in ops if op[0] not in clean.OPERATIONS]:
        raise ValueError(f"unknown operation {unknown[0]!r}")
    return data.get("source", ""), ops


def replay(df: DataFrame, ops: list[tuple]) -> tuple[DataFrame, list[tuple], list[tuple]]:
    """The cleaned frame, operations applied, and those skipped because their column is not there at that point."""
    applied, skipped = [], []
    for op in ops:
        column = clean.needs(op)
        if column is not None and column not in df.columns:
            skipped.append(op)
            continue
        df = clean.apply(df, op)
        applied.append(op)
    return df, applied, skipped


# How an operation reads; its arguments go into the braces.
SENTENCES = {
    "dropDuplicates": "Drop repeated rows", "dropEmptyRows": "Drop rows without any value", "trimWhitespace": "Trim spaces", "fixEncoding": "Repair broken characters",
    "standardizeCase": "Write {0} with capitals", "mergeValues": "Merge spellings in {0}", "convertExcelDates": "Turn day numbers of {0} into dates", "findReplace": "Replace {1!r} by {2!r} in {0}",
    "splitColumn": "Split {0} at {1!r}", "dropColumn": "Drop {0}", "fillMissing": "Fill blanks of {0} with the {1}", "capOutliers": "Cap outliers of {0}", "dropOutlierRows": "Drop rows with outliers in {0}",
}


def describe_op(op: tuple) -> str:
    return SENTENCES[op[0]].format(*("all columns" if a is None else a for a in op[1:]))


def fixes(p: Profile) -> list[tuple]:
    """Operations of all findings that can be repaired without a decision."""
    return [d.fix for d in p.diagnostics if d.fix and not d.manual and not d.skipped]


@dataclass(frozen=True)
class Dataset:
    """A lazy frame with its name and the operations that made it; a change is a new Dataset, and undo goes back."""

    name: str
    df: DataFrame
    ops: tuple[tuple, ...] = ()
    past: tuple[Dataset, ...] = field(default=(), repr=False)
    future: tuple[Dataset, ...] = field(default=(), repr=False)
    truncated: bool = False

    @classmethod
    def of(cls, name: str, df: DataFrame, *order: str, truncated: bool = False) -> Dataset:
        return cls(name, with_rows(df, *order), truncated=truncated)

    def profile(self, skipped: frozenset[str] = frozenset()) -> Profile:
        return profile(self.df, skipped)

    def apply(self, *ops: tuple) -> Dataset:
        df, applied, _ = replay(self.df, list(ops))
        return Dataset(self.name, df, (*self.ops, *applied), (*self.past, self)[-UNDO:], (), self.truncated)

    def fix_all(self) -> Dataset:
        return self.apply(*fixes(self.profile()))

    def undo(self) -> Dataset:
        if not self.past:
            return self
        last = self.past[-1]
        return Dataset(last.name, last.df, last.ops, self.past[:-1], (self, *self.future), last.truncated)

    def redo(self) -> Dataset:
        if not self.future:
            return self
        next_ = self.future[0]
        return Dataset(next_.name, next_.df, next_.ops, (*self.past, self)[-UNDO:], self.future[1:], next_.truncated)

    @classmethod
    def load(cls, spark: SparkSession, path: str, limit: int | None = None) -> Dataset:
        """A file by the ending of its name; with ``limit`` its first rows, and whether there are more."""
        df = files.load(spark, path)
        more = limit is not None and df.limit(limit + 1).count() > limit
        return cls.of(files.dataset_name(path), df.limit(limit) if more else df, truncated=more)

    def join(self, other: Dataset, left: str, right: str, how: str = "inner") -> Dataset:
        """A joined dataset: incomplete if either side is."""
        both = joins.join(self.df.drop(ROW), other.df.drop(ROW), left, right, how)
        return Dataset.of(f"{self.name} + {other.name}", both, truncated=self.truncated or other.truncated)

    def preview(self, op: tuple) -> clean.Difference:
        return clean.difference(self.df, op)

    def changelog(self) -> list[str]:
        """What has been done, a line for each operation, in order."""
        return [f"{k}. {describe_op(op)}" for k, op in enumerate(self.ops, 1)]

    @property
    def columns(self) -> list[str]:
        return data_columns(self.df)
