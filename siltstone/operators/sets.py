"""Set operations on whole rows that count repeated rows, by signed counts on 128-bit row hashes.

Only hashes and counts of two tables are shuffled; rows themselves move where the counts differ, which in
two states of one table is seldom. Nulls equal each other, as NaNs do, and 0.0 equals -0.0.
Columns are compared by place; their types have to be the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(df: DataFrame, names: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row, with a mask of its nulls, so that a null differs from a value in another place."""
    types = dict(df.dtypes)

    def value(c: str) -> Column:
        if types[c] in ("float", "double"):
            return F.col(c) + F.lit(0.0)
        return F.to_json(c) if types[c].startswith(("map", "array", "struct", "variant")) else F.col(c)

    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in names))
    values = [value(c) for c in names]
    return F.xxhash64(nulls, *values), F.xxhash64(F.lit("second"), *values[::-1], nulls)


def _placed(df: DataFrame) -> DataFrame:
    """Columns by place, and the hashes h1 and h2."""
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    h1, h2 = row_hash(flat, flat.columns)
    return flat.withColumns({"h1": h1, "h2": h2})


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    if [t for _, t in a.dtypes] != [t for _, t in b.dtypes]:
        raise ValueError("the tables differ in the number or types of their columns")
    return _placed(a), _placed(b)


def _counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """h1, h2, before, after: how often each row stands in either table."""
    both = a.select("h1", "h2", F.lit(1).alias("before"), F.lit(0).alias("after")).unionAll(b.select("h1", "h2", F.lit(0), F.lit(1)))
    return both.groupBy("h1", "h2").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))


def _one_each(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of each wanted hash with what ``wanted`` says of it; equal rows are combined in each task."""
    data = [c for c in rows.columns if c not in ("h1", "h2")]
    found = rows.join(wanted.select("h1", "h2"), ["h1", "h2"], "left_semi")
    one = found.groupBy("h1", "h2").agg(F.first(F.struct(*data)).alias("row"))
    return one.join(wanted, ["h1", "h2"])


def _repeated(a: DataFrame, b: DataFrame, times: Column) -> DataFrame:
    left, right = _sides(a, b)
    wanted = _counts(left, right).select("h1", "h2", times.alias("k")).filter("k > 0")
    out = _one_each(left, wanted).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k")))).select("row.*")
    return out.toDF(*a.columns)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` has not as often, as many times as are over."""
    return _repeated(a, b, F.col("before") - F.col("after"))


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, as often as the table that has fewer of them has them."""
    return _repeated(a, b, F.least("before", "after"))


def changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two states of a table do not have equally often, each once: the columns, before, after (counts)."""
    left, right = _sides(a, b)
    wanted = _counts(left, right).filter("before <> after")
    out = _one_each(left.unionAll(right), wanted).select("row.*", "before", "after")
    return out.toDF(*a.columns, "before", "after")
