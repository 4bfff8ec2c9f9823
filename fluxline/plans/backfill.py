"""Planning a backfill by days: what to do, what is done, what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxline import constants as C


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(day, day_start, day_end) covering [start, end) with exact edges."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    one = F.expr("INTERVAL 1 DAY")
    base = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).filter(lo < hi)
    first = F.date_trunc("day", "lo")
    last = F.greatest(first, F.col("hi") - F.expr("INTERVAL 1 MICROSECOND"))
    return base.select(
        "lo", "hi", F.explode(F.sequence(first, last, one)).alias("d"),
    ).select(
        F.to_date("d").alias("day"),
        F.greatest("d", "lo").alias("day_start"),
        F.least(F.col("d") + one, F.col("hi")).alias("day_end"),
    )


def remaining(plan: DataFrame, completed: DataFrame, failed: DataFrame | None = None,
              retry_failed: bool = False, key: str = "day") -> DataFrame:
    """Days not completed yet, or with ``retry_failed`` only the failed ones."""
    if retry_failed:
        return plan.join(failed.select(key).distinct(), key, "left_semi")
    return plan.join(completed.select(key).distinct(), key, "left_anti")


def expects_plasma(day_start: Column) -> Column:
    return day_start < F.lit(C.PLASMA_END).cast("timestamp")


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: days, first, last, with plasma, mag only."""
    with_plasma = expects_plasma(F.col("day_start"))
    return plan.agg(
        F.count(F.lit(1)).alias("total_days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count_if(with_plasma).alias("days_with_plasma"),
        F.count_if(~with_plasma).alias("days_mag_only"),
    )
