"""Regular time grids: bucket starts, complete spines, resampling, lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CADENCES = {"hour": 3600, "minute": 60}


def cadence_seconds(cadence: str) -> int:
    if cadence not in CADENCES:
        raise ValueError(f"cadence must be one of {sorted(CADENCES)}; got {cadence!r}")
    return CADENCES[cadence]


def truncated(df: DataFrame, ts: str, unit: str) -> Column:
    """``date_trunc`` that keeps the column's own timestamp type."""
    return F.date_trunc(unit, F.col(ts)).cast(df.schema[ts].dataType)


def spine(df: DataFrame, ts: str, cadence: str, name: str = "ts") -> DataFrame:
    """Every step from the first to the last row of ``df``, gaps included.

    Built in two levels, days and then steps of a day, so that the steps are
    made by all tasks and no array grows with the length of the range.
    """
    cadence_seconds(cadence)
    kind = df.schema[ts].dataType
    bounds = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(
        F.date_trunc(cadence, "lo").cast(kind).alias("t0"),
        F.date_trunc(cadence, "hi").cast(kind).alias("t1"),
    )
    day0 = F.date_trunc("day", "t0").cast(kind)
    days = bounds.filter(F.col("t0").isNotNull()).select(
        "t0", "t1", F.explode(F.sequence(day0, F.col("t1"), F.expr("INTERVAL 1 DAY"))).alias("day")
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.expr(f"INTERVAL 1 {cadence.upper()}")
    last = F.least("t1", F.col("day") + F.expr("INTERVAL 1 DAY") - step)
    return days.repartition(parts, "day").select(
        F.explode(F.sequence(F.greatest("t0", "day"), last, step)).alias(name)
    )


def resample(
    df: DataFrame, ts: str, cadence: str, aggs: Sequence[Column], name: str = "ts"
) -> DataFrame:
    """Aggregates per grid step; partial sums are combined before the shuffle."""
    cadence_seconds(cadence)
    return df.groupBy(truncated(df, ts, cadence).alias(name)).agg(*aggs)


def lagged(
    grid: DataFrame,
    ts: str,
    columns: Sequence[str],
    lags: Sequence[int],
    step_seconds: int,
    block_steps: int = 20_000,
) -> DataFrame:
    """Adds ``{column}__{lag}``: the value ``lag`` steps earlier on a full grid.

    The grid is cut into blocks of ``block_steps``. Each block also receives
    the last ``max(lags)`` rows of the block before, so a window inside the
    block sees all it needs and every task gets the same number of rows.
    """
    reach = max(lags, default=0)
    if reach > block_steps:
        raise ValueError("block_steps must be at least the longest lag")
    index = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / step_seconds).cast("long")
    block = F.floor(F.col("__i") / block_steps).cast("long")
    feeds_next = F.col("__i") % block_steps >= block_steps - reach
    copies = F.when(
        feeds_next,
        F.array(
            F.struct(block.alias("b"), F.lit(False).alias("halo")),
            F.struct((block + 1).alias("b"), F.lit(True).alias("halo")),
        ),
    ).otherwise(F.array(F.struct(block.alias("b"), F.lit(False).alias("halo"))))
    w = Window.partitionBy("__c.b").orderBy("__i")
    out = grid.withColumn("__i", index).withColumn("__c", F.explode(copies))
    out = out.select(
        *grid.columns,
        "__c",
        *[
            (F.lag(c, k).over(w) if k else F.col(c)).alias(f"{c}__{k}")
            for c in columns
            for k in lags
        ],
    )
    return out.filter(~F.col("__c.halo")).drop("__c")
