"""Equi-joins on cleaned keys: case and edge spaces do not count, blanks never match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.functions.names import quoted

KINDS = ("inner", "left", "right", "full")


def join_key(c: Column) -> Column:
    """What keys are compared by; null for blank ones."""
    return F.nullif(F.lower(cells.trim(c)), F.lit(""))


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Left columns, then right ones without their key; other names in both get _left and _right.

    Matched rows keep the left spelling of the key; rows of the right side alone
    have its key in the left key's column. Spark picks broadcast or shuffle by
    size and splits skewed keys.
    """
    if how not in KINDS:
        raise ValueError(f"a join is one of {KINDS}")
    if left_key != right_key and left_key in right.columns:
        raise ValueError(f"{left_key!r} is also a column of the right side")
    both = (set(left.columns) & set(right.columns)) - {left_key, right_key}
    names_l = [f"{c}_left" if c in both else c for c in left.columns]
    names_r = [f"{c}_right" if c in both else c for c in right.columns if c != right_key]
    a = left.select(*(F.col(quoted(c)).alias(f"l{i}") for i, c in enumerate(left.columns)), join_key(F.col(quoted(left_key))).alias("lk"))
    b = right.select(*(F.col(quoted(c)).alias(f"r{i}") for i, c in enumerate(right.columns)), join_key(F.col(quoted(right_key))).alias("rk"), F.lit(1).alias("rhas"))
    a = a.withColumn("lhas", F.lit(1))
    j = a.join(b, a["lk"] == b["rk"], how)
    k, r = left.columns.index(left_key), right.columns.index(right_key)
    key = F.when(F.col("lhas").isNull(), F.col(f"r{r}").cast(left.schema[left_key].dataType)).otherwise(F.col(f"l{k}"))
    out = [key.alias(names_l[k]) if i == k else F.col(f"l{i}").alias(n) for i, n in enumerate(names_l)]
    out += [F.col(f"r{i}").alias(n) for i, n in zip([i for i, c in enumerate(right.columns) if c != right_key], names_r, strict=True)]
    return j.select(*out)
