"""Spellings of one value, over any number of values: pairs are found by what is left after two deletions, not by comparing all with all.

A rare spelling belongs to a common one that stands at least twice as often if both are equal without case and
spaces, if one is the other's plural, or if they are five letters or longer and differ by two edits at
most. Two such texts share a string that either becomes by deleting up to two characters of its first ``PREFIX`` ones;
a join on hashes of these strings finds every pair, and the distance is worked out with an early exit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators.query import ROW, col
from siltstone.sources import scratch

EDITS, SHORTEST, PREFIX = 2, 5, 20
#: Distinct values of a column for which spellings are looked at by default.
FEWEST, MOST = 2, 25


def spelling_key(c: Column) -> Column:
    """Lower case, one blank for white space, none around a hyphen."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit(" - "), F.lit("-")), f"[{cells.SPACES}]+", " "))


def _left_over(key: Column) -> Column:
    """Hashes of what is left of the first ``PREFIX`` characters after no, one and two deletions."""
    s = F.substr(key, F.lit(1), F.lit(PREFIX))
    n = F.length(s)
    rest = lambda at: F.substr(s, at + 1, n)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), rest(i)))
    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, j - i - 1), rest(j)))))
    return F.array_distinct(F.transform(F.concat(F.array(s), one, two), lambda x: F.xxhash64(x)))


def _left_rows(texts: DataFrame, value: str, key: str, n: str) -> DataFrame:
    """The text's hash, its count and a hash of each string left over: equal hashes of two texts only add candidates, which are compared as texts."""
    return texts.filter(F.length(key) >= SHORTEST).select(F.xxhash64(value).alias(f"{value}_id"), n, F.explode(_left_over(F.col(key))).alias("h"))


def pairs(counts: DataFrame) -> DataFrame:
    """rare, common, n (of the common one), first (its first row): every pair of spellings. ``counts`` has value, n, first; values are distinct."""
    keyed = counts.withColumn("key", spelling_key(F.col("value"))).filter("key <> ''")
    rare = keyed.select(F.col("value").alias("rare"), F.col("key").alias("a"), F.col("n").alias("k"))
    common = keyed.filter("n >= 2").select(F.col("value").alias("common"), F.col("key").alias("b"), "n", "first")
    often = (F.col("rare") != F.col("common")) & (F.col("n") >= 2 * F.col("k"))
    plural = lambda d, side: d.select("*", F.explode(F.array(F.col(side), F.concat(side, F.lit("s")))).alias("h"))
    same = plural(rare, "a").hint("merge").join(plural(common, "b"), "h").filter(often & ((F.col("a") == F.col("b")) | (F.col("a") == F.concat("b", F.lit("s"))) | (F.col("b") == F.concat("a", F.lit("s")))))
    # what is left over is some eighty rows a text, which no size estimate knows: such rows hold numbers alone, and no side is broadcast
    left = _left_rows(rare, "rare", "a", "k")
    met = left.hint("merge").join(_left_rows(common, "common", "b", "n"), "h").filter("n >= 2 * k").select("rare_id", "common_id").distinct()
    near = met.join(rare.hint("merge").withColumn("rare_id", F.xxhash64("rare")), "rare_id").join(common.hint("merge").withColumn("common_id", F.xxhash64("common")), "common_id")
    near = near.filter(often & (F.abs(F.length("a") - F.length("b")) <= EDITS) & (F.levenshtein("a", "b", EDITS) >= 0))
    names = ["rare", "common", "n", "first"]
    return same.select(*names).unionByName(near.select(*names)).distinct()


def resolved(found: DataFrame) -> DataFrame:
    """rare, common: each rare spelling with the commonest one (ties: first row) that is not a rare one itself.

    A common spelling stands at least twice as often as its rare one, so there are few rounds (as many as a count can be halved);
    in each, spellings whose candidates are all decided are decided.
    """
    spark = found.sparkSession
    folder = scratch.new_folder(spark, "spellings")
    found.write.parquet(f"{folder}/pairs")
    found = spark.read.parquet(f"{folder}/pairs")
    rares = found.select("rare").distinct()
    # a common one that never is rare stays; ranks: whether a spelling is rare (true), stays (false), or is open (null)
    k = 0
    state = found.select(F.col("common").alias("v")).distinct().join(rares.select(F.col("rare").alias("v")), "v", "left_anti").select("v", F.lit(False).alias("moved"))
    state.write.parquet(f"{folder}/state0")
    while True:
        state = spark.read.parquet(f"{folder}/state{k}")
        open_ = found.join(state.select(F.col("v").alias("rare")), "rare", "left_anti").join(state.withColumnRenamed("v", "common"), "common", "left")
        decided = open_.groupBy("rare").agg(F.count_if(F.col("moved").isNull()).alias("open"), F.count_if(~F.col("moved")).alias("stay")).filter("open = 0").select(F.col("rare").alias("v"), (F.col("stay") > 0).alias("moved"))
        k += 1
        decided.unionByName(state).write.parquet(f"{folder}/state{k}")
        if spark.read.parquet(f"{folder}/state{k}").count() == state.count():
            break
    final = spark.read.parquet(f"{folder}/state{k}")
    kept = found.join(final.filter("not moved").select(F.col("v").alias("common")), "common")
    return kept.groupBy("rare").agg(F.min_by("common", F.struct(-F.col("n"), "first")).alias("common"))


def variants(df: DataFrame, name: str, most: int | None = MOST) -> DataFrame:
    """rare, common of one column's values, trimmed. With more than ``most`` distinct values (None: no limit) or under two there are none."""
    v = cells.trim(col(name))
    counts = df.filter(v != "").groupBy(v.alias("value")).agg(F.count("*").alias("n"), F.min(ROW).alias("first"))
    if most is not None and not FEWEST <= counts.limit(most + 1).count() <= most:
        counts = counts.limit(0)
    return resolved(pairs(counts))
