"""Windowed streams: resampling, hourly reports, label attachment.

They reuse the batch expressions. Tumbling windows are half-open, and rows
later than the watermark are dropped by Spark, unlike in the batch reports. In
append mode a window comes out once closed; ``run.drain_newest`` also gives those
still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxline.operators.grid import cadence_seconds
from fluxline.operators.intervals import interval_join
from fluxline.operators.ordered import neighbour
from fluxline.operators.slices import measured
from fluxline.plans import reports

DELAY = "10 minutes"


def _marked(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a timestamp with time zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def resample(stream: DataFrame, ts: str, cadence: str, aggs: dict[str, Column],
             delay: str = DELAY, name: str = "ts") -> DataFrame:
    """Named aggregates per grid step, emitted once the step is closed."""
    cadence_seconds(cadence)
    out = _marked(stream, ts, delay).groupBy(F.window(ts, f"1 {cadence}").alias("__w")).agg(
        *[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("__w.start").alias(name), *aggs)


def hourly_report(stream: DataFrame, ts: str = "timestamp", delay: str = DELAY) -> DataFrame:
    """Totals and posture per closed hour."""
    out = _marked(stream, ts, delay).groupBy(F.window(ts, "1 hour").alias("__w")).agg(
        *reports.totals())
    return out.withColumn("posture", reports.posture()).withColumn(
        "hour", F.col("__w.start")).drop("__w")


def hourly_objects(stream: DataFrame, ts: str = "timestamp", delay: str = DELAY) -> DataFrame:
    """Each object seen in an hour, once."""
    seen = _marked(stream, ts, delay).filter(
        F.col("event_type").isin(reports.INGESTED, reports.ALERT))
    return seen.select(F.window(ts, "1 hour").alias("__w"), "source").dropDuplicates(
        ["__w", "source"]).select(F.col("__w.start").alias("hour"), "source")


def validity(labels: DataFrame, ts: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Label rows with the time they hold: until just before the next one. The
    last one holds for ever; its end is NULL."""
    nxt = neighbour(labels, [ts], {ts: "__next"}, forward=True, slices=measured(labels, [ts]))
    until = F.col("__next") - F.expr("INTERVAL 1 MICROSECOND")
    return nxt.withColumn(end, until).withColumnRenamed(ts, start).drop("__next")


def attach_labels(stream: DataFrame, labels: DataFrame, ts: str, label_ts: str = "timestamp",
                  bucket_seconds: int = 3 * 3600) -> DataFrame:
    """Stream rows with the label that holds at their time (stream-static)."""
    held = validity(labels, label_ts)
    joined = interval_join(stream, held.filter("valid_to IS NOT NULL"), ts, "valid_from", "valid_to", how="left",
                           bucket_seconds=bucket_seconds)
    # The last label has no end to cut into buckets: one row, put in as it is.
    last = held.filter("valid_to IS NULL").orderBy(F.desc("valid_from")).first()
    if last is None:
        return joined
    since = F.col(ts) >= F.lit(last["valid_from"]).cast(held.schema["valid_from"].dataType)
    return joined.withColumns({
        f.name: F.when(since, F.lit(last[f.name]).cast(f.dataType)).otherwise(F.col(f.name)) for f in held.schema})
