"""A small messy table to try things on: a repeat, a blank row, stray spaces, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 52


def churn(spark: SparkSession) -> DataFrame:
    """customer_id, name, tier, monthly_charge, api_calls, support_tickets, churn_risk: 52 rows, always the same."""
    i = F.col("id")
    tier = F.element_at(F.array(F.lit("Basic"), F.lit("Pro "), F.lit("Enterprise")), (i % 3 + 1).cast("int"))
    rows = spark.range(ROWS - 1).select(
        F.format_string("C-%04d", F.when(i == 30, 10).otherwise(i)).alias("customer_id"), F.concat(F.lit("Customer "), F.when(i == 30, 10).otherwise(i)).alias("name"),
        F.when(i == 30, "Pro ").otherwise(tier).alias("tier"), F.when(i % 11 != 5, 20.0 + F.when(i == 30, 10).otherwise(i) * 1.5).alias("monthly_charge"),
        (F.when(i == 30, 10).otherwise(i) * 37 % 900).alias("api_calls"), F.when(i % 13 != 7, F.when(i == 30, 10).otherwise(i) % 5).alias("support_tickets"), (F.when(i == 30, 10).otherwise(i) % 4 == 0).alias("churn_risk"),
    )
    return rows.unionByName(spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes)))
