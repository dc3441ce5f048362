"""Cleaning operations: each is a tuple (kind, arguments) that JSON can hold, and a lazy change of a DataFrame.

Row-local operations are projections that Spark folds into one. Fences, medians
and modes come from one aggregation and go into the plan as literals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.functions.names import quoted
from siltstone.operators.profile import data_columns
from siltstone.operators.quantiles import exact
from siltstone.operators.query import ROW, col, pinned

SPLIT_PARTS = 12


def _strings(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string" and n != ROW]


def _with(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.select(*(changes[c].alias(c) if c in changes else F.col(quoted(c)) for c in df.columns))


def fences(df: DataFrame, column: str) -> tuple[float, float] | None:
    """1.5 quartile ranges beyond the quartiles; none for under four numbers."""
    n = cells.as_number(col(column), dict(df.dtypes)[column])
    q, count = exact(df, {column: n}, [0.25, 0.75])[column]
    if count < 4:
        return None
    return q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])


def mode(df: DataFrame, column: str) -> object | None:
    """The commonest value that is not blank; of equally common ones whole numbers first, in order, then the one seen first."""
    c = col(column)
    whole = F.when(cells.text_of(c).rlike(r"^(0|[1-9]\d*)$"), cells.text_of(c).try_cast("long"))
    counts = df.filter(~cells.is_blank(c)).groupBy(c.alias("v")).agg(F.count("*").alias("n"), F.min(ROW).alias("first"), F.first(whole).alias("w"))
    top = counts.orderBy(F.desc("n"), F.col("w").asc_nulls_last(), "first").select("v").first()
    return top[0] if top else None


def _drop_duplicates(df: DataFrame) -> DataFrame:
    """Of equal rows the first stays. Rows are compared by two hashes of all cells."""
    parts = [F.coalesce(cells.text_of(col(c)), F.lit("\0")) for c in data_columns(df)]
    keys = F.xxhash64(*parts).alias("__a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("__b")
    # each task keeps one row of a key before any row is shuffled, so a row of many copies makes no large task
    return df.groupBy(*keys).agg(F.min_by(F.struct(*map(quoted, df.columns)), ROW).alias("__row")).select("__row.*")


def _drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.filter(~reduce(lambda a, b: a & b, (cells.is_blank(col(c)) for c in data_columns(df))))


def _split_column(df: DataFrame, column: str, delimiter: str, keep: bool = False) -> DataFrame:
    """Parts of a text in columns of their own, in its place; blank parts are null, parts past the twelfth are dropped."""
    parts = F.split(cells.text_of(col(column)), "\\Q" + delimiter + "\\E", -1)
    n = min(SPLIT_PARTS, df.agg(F.max(F.size(parts))).first()[0] or 0)
    if n < 2:
        return df
    taken, out = set(df.columns), []
    for c in df.columns:
        if c != column:
            out.append(F.col(quoted(c)))
            continue
        if keep:
            out.append(F.col(quoted(c)))
        for i in range(n):
            name = f"{column}_{i + 1}"
            while name in taken:
                name += "x"
            taken.add(name)
            out.append(F.nullif(cells.trim(F.get(parts, F.lit(i))), F.lit("")).alias(name))
    return df.select(*out)


def _fill_missing(df: DataFrame, column: str, how: str) -> DataFrame:
    kind = dict(df.dtypes)[column]
    if how == "median":
        middle, _ = exact(df, {column: cells.as_number(col(column), kind)}, [0.5])[column]
        if not middle:
            return df
        value = middle[0]
        number = f"{value:.0f}" if value == int(value) else repr(value)
        fill = F.lit(number) if kind == "string" else F.lit(value).cast(kind)
    else:
        value = mode(df, column)
        if value is None:
            return df
        fill = F.lit(value)
    return _with(df, {column: F.when(cells.is_blank(col(column)), fill).otherwise(col(column))})


def _cap_outliers(df: DataFrame, column: str) -> DataFrame:
    limits = fences(df, column)
    if limits is None:
        return df
    kind = dict(df.dtypes)[column]
    n = cells.as_number(col(column), kind)
    target = "string" if kind == "string" else "double"
    capped = F.when(n < limits[0], F.lit(limits[0]).cast(target)).when(n > limits[1], F.lit(limits[1]).cast(target)).otherwise(col(column).cast(target))
    return _with(df, {column: capped})


def _drop_outlier_rows(df: DataFrame, column: str) -> DataFrame:
    limits = fences(df, column)
    n = cells.as_number(col(column), dict(df.dtypes)[column])
    return df if limits is None else df.filter(n.isNull() | n.between(*limits))


def _find_replace(df: DataFrame, column: str | None, find: str, replacement: str, match_case: bool = False) -> DataFrame:
    """A literal text by another, in one text column or all; null for all."""
    if not find:
        return df
    pattern = ("" if match_case else "(?i)") + "\\Q" + find.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    put = replacement.replace("\\", "\\\\").replace("$", "\\$")
    chosen = [c for c in _strings(df) if column in (None, c)]
    return _with(df, {c: F.regexp_replace(col(c), F.lit(pattern), F.lit(put)) for c in chosen})


def _merge_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    if not mapping:
        return df
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return _with(df, {column: F.coalesce(F.element_at(table, cells.trim(col(column))), col(column))})


OPERATIONS = {
    "dropDuplicates": _drop_duplicates,
    "dropEmptyRows": _drop_empty_rows,
    "trimWhitespace": lambda df: _with(df, {c: cells.squeeze(col(c)) for c in _strings(df)}),
    "fixEncoding": lambda df: _with(df, {c: cells.fix_encoding(col(c)) for c in _strings(df)}),
    "standardizeCase": lambda df, column: _with(df, {column: cells.standard_case(col(column))}),
    "mergeValues": _merge_values,
    "convertExcelDates": lambda df, column: _with(df, {column: cells.serial_day(col(column))}),
    "findReplace": _find_replace,
    "splitColumn": _split_column,
    "dropColumn": lambda df, column: df.drop(F.col(quoted(column))),
    "fillMissing": _fill_missing,
    "capOutliers": _cap_outliers,
    "dropOutlierRows": _drop_outlier_rows,
}
#: Operations whose first argument is no column that must be there.
WHOLE_TABLE = frozenset(["dropDuplicates", "dropEmptyRows", "trimWhitespace", "fixEncoding"])


def needs(op: tuple) -> str | None:
    """The column that an operation works on."""
    return None if op[0] in WHOLE_TABLE else op[1]


def apply(df: DataFrame, op: tuple) -> DataFrame:
    """One operation on a DataFrame that has ROW."""
    return OPERATIONS[op[0]](df, *op[1:])


def changes(before: DataFrame, op: tuple) -> tuple[DataFrame, DataFrame]:
    """What an operation would do: cells that change (row, column, before, after), and rows that go (row)."""
    before = pinned(before)
    after = apply(before, op)
    shared = [c for c in data_columns(before) if c in after.columns]
    a = before.select(ROW, F.array(*(cells.text_of(col(c)) for c in shared)).alias("a"))
    b = after.select(ROW, F.array(*(cells.text_of(col(c)) for c in shared)).alias("b"))
    pairs = a.join(b, ROW).select(ROW, F.explode(F.arrays_zip(F.array(*map(F.lit, shared)).alias("column"), "a", "b")).alias("x"))
    cells_ = pairs.select(F.col(ROW).alias("row"), F.col("x.column").alias("column"), F.col("x.a").alias("before"), F.col("x.b").alias("after")).filter(~F.col("before").eqNullSafe(F.col("after")))
    return cells_, before.join(after.select(ROW), ROW, "left_anti").select(F.col(ROW).alias("row"))


#: Changed cells that a difference keeps in detail; counts are always whole.
DETAIL = 500


@dataclass(frozen=True)
class Difference:
    """What an operation does to a table."""

    changed_cells: int
    removed_rows: int
    affected: list[str]
    added: list[str]
    removed: list[str]
    detail: DataFrame
    gone: DataFrame
    after: DataFrame


def difference(before: DataFrame, op: tuple, most: int = DETAIL) -> Difference:
    """Exact counts, columns that are affected, added or removed, the first ``most`` changed cells by row and place, and the rows that go."""
    before = pinned(before)
    after = apply(before, op)
    cells_, gone = changes(before, op)
    counts = {r["column"]: r["count"] for r in cells_.groupBy("column").count().collect()}
    place = F.array_position(F.array(*map(F.lit, data_columns(before))), F.col("column"))
    old, new = data_columns(before), data_columns(after)
    return Difference(sum(counts.values()), gone.count(), [c for c in old if c in counts], [c for c in new if c not in old], [c for c in old if c not in new], cells_.orderBy("row", place).limit(most), gone, after)


def repeated_positions(df: DataFrame) -> DataFrame:
    """Rows (row) that repeat an earlier one."""
    parts = [F.coalesce(cells.text_of(col(c)), F.lit("\0")) for c in data_columns(df)]
    keyed = df.select(ROW, F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b"))
    return keyed.withColumn("k", F.row_number().over(W.partitionBy("a", "b").orderBy(ROW))).filter("k > 1").select(F.col(ROW).alias("row"))
