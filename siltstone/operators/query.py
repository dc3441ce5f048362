"""Filters, groups and orders with spreadsheet semantics.

Predicates are two-valued: a null cell compares as an empty text. Numbers compare
as numbers if both sides show one, other cells as text without regard to case.
A hidden row number, ``ROW``, makes "first" mean something in a DataFrame.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.functions.names import quoted

ROW = "_rid"


def col(name: str) -> Column:
    return F.col(quoted(name))


def with_rows(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ROW: rising in file order, or in the order of unique columns where those are given.

    File order takes no shuffle: a number by partition and place, which Spark
    gives again when a lost partition is read anew.
    """
    if ROW in df.columns:
        return df
    if len(order) == 1 and dict(df.dtypes)[order[0]] in ("int", "bigint"):
        return df.withColumn(ROW, col(order[0]).cast("long"))
    return df.withColumn(ROW, F.monotonically_increasing_id())


def compare(c: Column, op: str, value: object, dtype: str = "string") -> Column:
    """``c op value`` for = != < > <= >=; never null."""
    left, right = cells.as_number(c, dtype), F.lit(None if isinstance(value, bool) else _number(value)).cast("double")
    ltext, rtext = F.lower(F.coalesce(cells.text_of(c), F.lit(""))), F.lit("" if value is None else str(value).lower())

    def by(a: Column, b: Column) -> Column:
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    if _number(value) is None:
        return by(ltext, rtext)
    return F.when(left.isNotNull(), by(left, right)).otherwise(by(ltext, rtext))


def _number(value: object) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    s = str(value).strip()
    sign = -1 if re.fullmatch(r"\(.*\)", s) else 1
    s = re.sub(r"[$€£¥₦,%\s]", "", s[1:-1] if sign < 0 else s)
    return sign * float(s) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s) else None


def like(c: Column, pattern: str) -> Column:
    """``%`` and ``_`` as in SQL, without regard to case; null is an empty text."""
    body = "".join(".*" if ch == "%" else "." if ch == "_" else "\\Q" + ch + "\\E" for ch in pattern)
    return F.coalesce(cells.text_of(c), F.lit("")).rlike(f"(?i)^{body}$")


def any_of(*groups: Sequence[Column]) -> Column:
    """OR of ANDs; no group at all matches nothing."""
    return reduce(or_, [reduce(and_, g) for g in groups if g], F.lit(False))


def pinned(df: DataFrame) -> DataFrame:
    """``df`` computed once into the folder of ``spark.checkpoint.dir``, so that its rows have the same numbers wherever it is used; as it is where no such folder is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not folder:
            return df
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def unknown_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Names that ``df`` does not have in just that spelling: capitals count, where Spark's own resolution lets them pass."""
    return [n for n in names if n not in df.columns]


def known(df: DataFrame, *names: str) -> DataFrame:
    """``df`` if it has all the names, else a ValueError that tells which are missing and what there is."""
    if missing := unknown_columns(df, names):
        raise ValueError(f"unknown column {', '.join(map(repr, missing))}; there are {', '.join(c for c in df.columns if c != ROW)}")
    return df


@dataclass(frozen=True)
class Answer:
    """What a statement gave: its frame or the error's text, and the milliseconds that it took (0.1 at least)."""

    df: DataFrame | None
    error: str | None
    ms: float


def ask(spark: SparkSession, sql: str, **views: DataFrame) -> Answer:
    """A guarded statement whose errors are text. Planning alone is timed: the frame is lazy."""
    began = time.perf_counter()
    df = error = None
    try:
        df = read_only(spark, sql, **views)
        df.schema  # noqa: B018  resolves names
    except (ValueError, PySparkException) as e:
        df, error = None, str(e).split("\n")[0]
    return Answer(df, error, max(0.1, (time.perf_counter() - began) * 1000))


def first_value(name: str) -> Column:
    """The group's value in its first row."""
    return F.min_by(col(name), F.col(ROW))


def aggregate(kind: str, c: Column | None, dtype: str = "string", distinct: bool = False) -> Column:
    """count, sum, avg, min or max over what shows a number (count: over what is not null); without any: null."""
    if kind == "count":
        return F.count(F.lit(1)) if c is None else F.count_distinct(c) if distinct else F.count(c)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[kind](cells.as_number(c, dtype))


def ordered(df: DataFrame, *keys: tuple[str, bool], tie: Sequence[str] = ()) -> DataFrame:
    """Sorted by (column, ascending?) with nulls last either way: by number where a text shows one, then by text."""
    out = []
    types = dict(df.dtypes)
    for name, up in keys:
        parts = [cells.number(col(name)), col(name)] if types[name] == "string" else [col(name)]
        out += [c.asc_nulls_last() if up else c.desc_nulls_last() for c in parts]
    return df.orderBy(*out, *(col(t) for t in tie))


# Words that change data or schema; a guarded statement has none of them.
WRITES = ["insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "merge", "replace", "call", "exec", "execute", "copy", "vacuum", "attach", "lock", "set"]


def guard_read_only(sql: str) -> str:
    """The statement without comments, or ValueError if it is not one that only reads tables; it may not call Java methods or name files."""
    bare = re.sub(r"/\*.*?\*/", " ", re.sub(r"--[^\n]*", " ", sql), flags=re.S).strip().rstrip(";").strip()
    outside = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", "''", bare)
    if ";" in outside:
        raise ValueError("one statement at a time")
    if not re.match(r"(select|with|show|describe|desc|explain)\b", outside, re.I):
        raise ValueError("only statements that read are allowed")
    if found := re.search(r"\b(reflect|try_reflect|java_method)\s*\(", outside, re.I):
        raise ValueError(f"{found[1].upper()} is not allowed")
    if re.search(r"\b(parquet|orc|csv|json|text|xml|avro|binaryfile|workbook)\s*\.\s*`", bare, re.I):
        raise ValueError("files are not allowed as tables")
    if found := re.search(r"\b(" + "|".join(WRITES) + r")\b", outside, re.I):
        raise ValueError(f"{found[1].upper()} is not allowed")
    return bare


def read_only(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """A guarded statement, by Spark's own SQL, over the views given by name."""
    bare = guard_read_only(sql)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(bare)
