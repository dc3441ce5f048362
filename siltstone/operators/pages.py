"""Pages of a table in a fixed order: written once by ranges of the order, counted by range, then found by seeking.

A page reads one range (two at an edge) instead of keeping all rows before it, however far it lies.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources import scratch

RANGE, PLACE = "__range", "__place"


@dataclass(frozen=True)
class Pages:
    """``rows`` has the table with the number of its range and the place in it; ``starts`` the first position of each range in order, with its number."""

    rows: DataFrame
    starts: tuple[tuple[int, int], ...]
    count: int
    size: int

    @classmethod
    def of(cls, df: DataFrame, *order: str | Column, size: int = 15, path: str | None = None) -> Pages:
        """Sort ``df`` by ranges of ``order`` into Parquet at ``path`` (else in the shared folder), one folder for each range."""
        spark = df.sparkSession
        path = path or scratch.new_folder(spark, "pages")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        place = F.monotonically_increasing_id()
        numbered = ordered.select("*", F.shiftright(place, 33).cast("int").alias(RANGE), place.bitwiseAND(F.lit((1 << 33) - 1)).alias(PLACE))
        numbered.write.partitionBy(RANGE).parquet(path)
        rows = spark.read.schema(numbered.schema).parquet(path)
        starts, at = [], 0
        for r in rows.groupBy(RANGE).agg(F.count("*").alias("n")).orderBy(RANGE).collect():  # as many rows as ranges
            starts.append((at, r[RANGE]))
            at += r["n"]
        return cls(rows, tuple(starts), at, size)

    @property
    def pages(self) -> int:
        return -(-self.count // self.size)

    def where(self, number: int) -> Column:
        """Which rows are on page ``number`` (from 0): a range and places in it, or several if the page goes over an edge."""
        low, high = number * self.size, min((number + 1) * self.size, self.count)
        if number < 0 or low >= high:
            return F.lit(False)
        first = [s for s, _ in self.starts]
        out = F.lit(False)
        for k in range(bisect_right(first, low) - 1, bisect_right(first, high - 1)):
            start, part = self.starts[k]
            out = out | ((F.col(RANGE) == part) & F.col(PLACE).between(low - start, high - 1 - start))
        return out

    def page(self, number: int) -> DataFrame:
        """Page ``number`` (from 0), in order; none beyond the last."""
        return self.rows.filter(self.where(number)).orderBy(RANGE, PLACE).drop(RANGE, PLACE)
