"""Line dedup by overlapping three-line windows.

Each run of three consecutive lines of a text is hashed (two 64-bit hashes of
different seeds). Windows that occur more than once are found by one aggregation
over all texts; the occurrence that is first in the order of (doc_id, text hash,
line number) stays, and the lines that later occurrences cover are removed, their
windows' positions merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import by_place, cut, pick

WINDOW = 3


def _hashes(lines: str, size: int) -> Column:
    """Two hashes of each window of ``size`` elements of the array column ``lines``, with its number."""
    last = F.size(lines) - size

    def window(i: Column) -> Column:
        part = [F.get(F.col(lines), i + k) for k in range(size)]
        return F.struct(i.alias("at"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(size), *part[::-1]).alias("h2"))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window))


def repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Lines to remove: doc_id, text_hash, lines (sorted array of line numbers, from 0); only of texts that have any.

    A repeated row (same doc_id and text) is one document given twice and no
    repeat of itself. Null or empty text and texts under ``size`` lines have no windows.
    """
    docs = pick(df, doc_id=doc_id, text=text)
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    windows = split.select("doc_id", "text_hash", F.explode(_hashes("lines", size)).alias("w")).select("doc_id", "text_hash", "w.*")
    place = F.struct("doc_id", "text_hash", "at")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last"))
    # written, so that both sides of the join are plain shuffles, of which Spark splits the rows of a window that most texts share
    firsts = cut(firsts.select("h1", "h2", "first"))
    later = windows.join(firsts.hint("merge"), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda a: F.sequence(a, a + (size - 1))))))
    return later.groupBy("doc_id", "text_hash").agg(covered.alias("lines"))


def _joined(docs: DataFrame, doc_id: Column, text: Column, gone: DataFrame) -> DataFrame:
    """``docs`` with __lines, all lines of a text from which some go, and __gone, their numbers; both null for other texts."""
    gone = gone.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("lines").alias("__gone"))
    both = docs.join(gone, doc_id.eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__h")), "left")
    return both.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split(text, "\n")))


def _kept() -> Column:
    numbers = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    return F.array_join(F.transform(numbers, lambda i: F.get(F.col("__lines"), i)), "\n")


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Every row of ``df`` once: doc_id, text without the removed lines, n_lines, n_removed.

    Null text stays null with 0 lines; an empty text has one line. The order of
    the lines that stay is kept. Empty table: no rows. Null doc_id: sorts before
    all others. Other columns are not read.
    """
    docs = pick(df, doc_id=doc_id, text=text)
    both = _joined(docs, F.col("doc_id"), F.col("text"), repeated_lines(df, doc_id, text, size))
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return both.select(
        "doc_id",
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_kept()).alias("text"),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's form: every column of ``docs``, with text and n_chars after the removal; a text of which nothing stays goes."""
    counted = any(c.lower() == "n_chars" for c in docs.columns)

    def stage(flat: DataFrame, doc_id: str, text: str, *n_chars: str) -> DataFrame:
        both = _joined(flat, flat[doc_id], flat[text], repeated_lines(flat, doc_id, text))
        changed = F.col("__gone").isNotNull()
        out = both.withColumn(text, F.when(changed, _kept()).otherwise(F.col(text)))
        for n in n_chars:
            out = out.withColumn(n, F.when(changed, F.length(text).cast("long")).otherwise(F.col(n)))
        return out.filter(~changed | (F.col(text) != ""))

    return by_place(docs, stage, "doc_id", "text", *["n_chars"] * counted)
