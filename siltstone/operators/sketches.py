"""Column facts that grow with the data: mergeable sketches by day, stored once and merged for any span without reading the rows again.

Beside exact counts of rows, blanks and numbers with their bounds, each day and column has a
HyperLogLog sketch of distinct values (relative error about 1.04 / sqrt(2**LG), 0.8 %), a KLL
sketch of numbers (rank error about 1 % at K = 400) and the values that are commonest among
``TRACKED`` ones (exact while a column has no more than three quarters of that many values). They are
estimates for watching a table over time; a profile's own figures stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.functions.names import quoted
from siltstone.operators.query import ROW

LG = 14
K = 400
TRACKED = 1000
TOP = 10
QUANTILES = (0.25, 0.5, 0.75)
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _stacked(df: DataFrame, day: Column, columns: list[str]) -> DataFrame:
    """day, column, text (trimmed, null if blank), number of each cell."""
    types = dict(df.dtypes)

    def cell(c: str) -> Column:
        text = F.nullif(cells.trim(F.col(quoted(c))), F.lit(""))
        return F.struct(F.lit(c).alias("column"), text.alias("text"), cells.as_number(F.col(quoted(c)), types[c]).alias("number"))

    return df.select(day.alias("day"), F.explode(F.array(*map(cell, columns))).alias("x")).select("day", "x.*")


def by_day(df: DataFrame, date: str, columns: list[str] | None = None) -> DataFrame:
    """One row for each day of ``date`` (null: no date) and column, in one pass over the columns: counts, bounds and sketches.

    Sketches are made in each task and merged after one shuffle of a sketch for each task, day and column.
    """
    names = columns or [c for c in df.columns if c not in (date, ROW)]
    rows = _stacked(df, F.to_date(F.col(quoted(date))), names)
    return rows.groupBy("day", "column").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("blanks"), F.count("number").alias("numbers"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.hll_sketch_agg("text", LG).alias("distinct"), F.kll_sketch_agg_double("number", K).alias("ranks"), F.expr(f"approx_top_k_accumulate(text, {TRACKED})").alias("common"),
    )


def save(facts: DataFrame, path: str) -> None:
    """Days of :func:`by_day` into the store; a day that is there already is replaced, others stay."""
    facts.repartition("day").write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored days, from ``first`` to ``last`` (both included); only their folders are read."""
    stored = spark.read.parquet(path)
    for bound, keep in ((first, F.col("day") >= F.lit(first)), (last, F.col("day") <= F.lit(last))):
        stored = stored if bound is None else stored.filter(keep)
    return stored


def merged(facts: DataFrame, *by: Column | str) -> DataFrame:
    """Facts of whole spans from those of days: by column, and by what else is given (a month of ``day``).

    column, n, blanks, numbers, low, high, distinct (estimate), quantiles (of QUANTILES, null without numbers), common (value and count, TOP of them).
    """
    one = facts.groupBy("column", *by).agg(
        *(F.sum(c).alias(c) for c in ("n", "blanks", "numbers")), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"), F.expr("approx_top_k_combine(common)").alias("common"),
    )
    quantiles = F.when(F.col("numbers") > 0, F.array(*(F.kll_sketch_get_quantile_double("ranks", F.lit(q)) for q in QUANTILES)))
    common = F.expr(f"filter(approx_top_k_estimate(common, {TOP}), x -> x.item is not null)")
    return one.withColumns({"distinct": F.hll_sketch_estimate("distinct"), "quantiles": quantiles, "common": common}).drop("ranks")
