"""Joining points to the intervals that cover them (both ends inclusive).

An interval is laid onto the time buckets it touches and a point onto its one
bucket; an equi-join on the bucket with a re-check of the bounds then finds
each (point, interval) pair exactly once. Only the two end buckets of an interval
can hold points that fail the re-check, so without a length given the bucket is a
part of the median interval, or longer where too many rows would be laid out.

Where a point has many intervals, points near in time go through the join as one
block and come out interval by interval. The pairs are the same; written to files,
whose columns then hold long runs and repeats, they take a fraction of the bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkTypeError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fluxline.operators.asof import asof_join
from fluxline.operators.ordered import position
from fluxline.operators.slices import Slices, measured
from fluxline.session import stored

# Parts of the median interval that a bucket is, where its length is measured, and
# how far few long intervals may be laid out: so many rows, or so many each.
BUCKETS, LAID_ROWS, LAID_EACH = 4, 200_000, 8
# Intervals laid out that are copied to every task, at most.
LOOKUP_ROWS = 1_000_000
LOOKUP_TEXT_BYTES = 16 << 20
# Where a point has more intervals than this on average, points are dealt evenly:
# what a task writes follows its points, not its share of the file.
DEEP = 16
# Points of a block, and bytes of those points, at most.
BLOCK_POINTS, BLOCK_BYTES = 256, 1 << 20


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds).cast("long")


def _laid(intervals: DataFrame, start: str, end: str) -> dict:
    """Number of intervals, their seconds together, their median, from when to when
    they run, and the bytes of their texts."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in intervals.schema.fields
             if f.dataType.simpleString() in ("string", "binary")]
    lo, hi = (F.unix_timestamp(F.col(c).cast("timestamp")) for c in (start, end))
    return intervals.filter(F.col(start) <= F.col(end)).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hi - lo), F.lit(0)).alias("seconds"),
        F.coalesce(F.percentile_approx(hi - lo, 0.5), F.lit(0)).alias("median"),
        F.coalesce(F.max(hi) - F.min(lo), F.lit(0)).alias("span"),
        F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0)).alias("text")).first().asDict()


def _dealt_in_blocks(points: DataFrame, intervals: DataFrame, ts: str, start: str, end: str) -> bool:
    """Whether all three times are of one type, whose order blocks can follow, and
    Arrow knows the points' columns."""
    times = {points.select(F.col(ts)).schema[0].dataType, *(f.dataType for f in intervals.select(F.col(start), F.col(end)).schema)}
    try:
        to_arrow_schema(points.schema)
    except PySparkTypeError:
        return False
    return len(times) == 1 and isinstance(next(iter(times)), (T.DateType, T.TimestampType, T.TimestampNTZType))


def _blocks(placed: DataFrame, ts: str) -> DataFrame:
    """Points of a bucket that are near in time as one row: ``__pb``, the list
    ``__points``, and its first and last time. Each task sorts its own points."""
    point = T.StructType([f for f in placed.schema.fields if f.name != "__pb"])
    timed = placed.filter(F.col("__pb").isNotNull()).withColumn("__ts", F.col(ts)).sortWithinPartitions("__pb", "__ts")
    time = timed.schema["__ts"].dataType
    schema = T.StructType([T.StructField("__pb", T.LongType()), T.StructField("__first", time),
                           T.StructField("__last", time), T.StructField("__points", T.ArrayType(point))])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            buckets, times = batch.column("__pb").to_numpy(zero_copy_only=False), batch.column("__ts")
            most = max(1, min(BLOCK_POINTS, BLOCK_BYTES * n // max(1, batch.nbytes)))
            heads = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
            starts = np.concatenate([np.arange(a, b, most) for a, b in zip(heads, np.append(heads[1:], n))])
            ends = np.append(starts[1:], n)
            columns = [batch.column(f.name) for f in point.fields]
            rows = pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, c.type) for f, c in zip(point.fields, columns)])
            yield pa.RecordBatch.from_arrays([
                pa.array(buckets[starts]), times.take(pa.array(starts)), times.take(pa.array(ends - 1)),
                pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), rows)], names=schema.names)

    return timed.mapInArrow(gathered, schema)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    ts: str,
    start: str,
    end: str,
    by: Sequence[str] = (),
    how: str = "inner",
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Points with the columns of each interval that covers them.

    ``how="left"`` keeps uncovered points once, with NULL interval columns.
    ``by`` names equality columns present on both sides. Without
    ``bucket_seconds`` the intervals are counted first: buckets follow their median
    length, and as long as they are few they are copied to the points' tasks. Where
    they lie deep, an inner join without ``by`` takes points block by block.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, got {how!r}")
    few = deep = False
    if bucket_seconds is None:
        size = _laid(intervals, start, end)
        laid = max(LAID_ROWS, LAID_EACH * size["n"])
        bucket_seconds = max(1, size["median"] // BUCKETS, -(-size["seconds"] // laid))
        rows = 2 * size["n"] + size["seconds"] // bucket_seconds
        few = rows <= LOOKUP_ROWS and size["text"] * rows <= LOOKUP_TEXT_BYTES * max(1, size["n"])
        deep = not points.isStreaming and size["seconds"] > DEEP * max(1, size["span"])
    lo, hi = _bucket(F.col(start), bucket_seconds), _bucket(F.col(end), bucket_seconds)
    spread = (
        intervals.filter(F.col(start) <= F.col(end))
        .withColumnsRenamed({k: f"__i_{k}" for k in by})
        .withColumn("__b", F.explode(F.sequence(lo, hi)))
    )
    placed = points.withColumn("__pb", _bucket(F.col(ts), bucket_seconds))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if deep and how == "inner" and not by and _dealt_in_blocks(points, intervals, ts, start, end):
        blocks = _blocks(placed, ts)
        if few:
            blocks = blocks.repartition(tasks)
        taken = {f"__i{i}": c for i, c in enumerate(intervals.columns)}
        spread = spread.select("__b", F.col(start).alias("__lo"), F.col(end).alias("__hi"),
                               *[F.col(c).alias(i) for i, c in taken.items()])
        near = (
            (F.col("__pb") == F.col("__b"))
            & (F.col("__last") >= F.col("__lo"))
            & (F.col("__first") <= F.col("__hi"))
        )
        met = blocks.join(F.broadcast(spread) if few else spread, near)
        return (
            met.select("__lo", "__hi", *taken, F.inline("__points"))
            .filter((F.col(ts) >= F.col("__lo")) & (F.col(ts) <= F.col("__hi")))
            .select(*points.columns, *[F.col(i).alias(c) for i, c in taken.items()])
        )
    if deep and few:
        placed = placed.repartition(tasks)
    cond = (
        (F.col("__pb") == F.col("__b"))
        & (F.col(ts) >= F.col(start))
        & (F.col(ts) <= F.col(end))
    )
    for k in by:
        cond = cond & (F.col(k) == F.col(f"__i_{k}"))
    keep = [c for c in intervals.columns if c not in by]
    return placed.join(F.broadcast(spread) if few else spread, cond, how).select(*points.columns, *keep)


def interval_flag(
    points: DataFrame,
    intervals: DataFrame,
    ts: str,
    start: str,
    end: str,
    marker: str,
    flag: str = "inside",
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Left interval join that adds a membership flag.

    ``marker`` is an interval column that is never NULL. As in a plain left
    join, a point under several intervals comes out once for each.
    """
    joined = interval_join(points, intervals, ts, start, end, how="left",
                           bucket_seconds=bucket_seconds)
    return joined.withColumn(flag, F.col(marker).isNotNull())


# -- the best covering interval -----------------------------------------------------

BOUNDS_PER_SLICE = 1_000_000
# At most so many slices, and a few numbers for each, are seen by the driver.
MAX_SLICES = 20_000
# Runs of slices, in slices; each width divides the one before.
_RUNS = tuple(4 ** i for i in reversed(range(8)))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _runs(first: Column, past: Column, level: int) -> Column:
    """Runs of a width inside the slices [first, past) that no wider run covers."""

    def up(c: Column, width: int) -> Column:
        return -F.floor(-c / width)

    def span(lo: Column, hi: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.when(lo < hi, F.sequence(lo, F.greatest(lo, hi - 1))).otherwise(none)

    w = _RUNS[level]
    lo, hi = up(first, w), F.floor(past / w)
    if level == 0:
        return span(lo, hi)
    wide = _RUNS[level - 1]
    ratio = wide // w
    wlo, whi = up(first, wide), F.floor(past / wide)
    return F.when(wlo < whi, F.concat(span(lo, wlo * ratio), span(whi * ratio, hi))).otherwise(span(lo, hi))


def _covers(spans: DataFrame, slices: int) -> np.ndarray:
    """Per slice the best rank among intervals that cover it whole; -1 if none.

    Each interval is laid out as the few runs of slices that make up its inside,
    and each run keeps its best rank before anything is shuffled.
    """
    def at(level: int) -> Column:
        return F.transform(_runs(F.col("a") + 1, F.col("b"), level),
                           lambda n: F.struct(F.lit(level).alias("level"), n.alias("run")))

    pieces = F.concat(*[at(level) for level in range(len(_RUNS))])
    best = spans.filter(F.col("b") > F.col("a") + 1).select("rank", F.explode(pieces).alias("p")).groupBy(
        "p.level", "p.run").agg(F.min("rank").alias("rank"))
    found = np.full(slices, np.iinfo(np.int64).max)
    # No more rows than runs of slices.
    for r in best.collect():
        w = _RUNS[r.level]
        part = found[r.run * w:(r.run + 1) * w]
        np.minimum(part, r["rank"], out=part)
    return np.where(found == np.iinfo(np.int64).max, -1, found)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of each slice from its intervals in order of their starts.

    Open intervals stand in a heap by rank; those that ended are dropped when
    they come to its top. The best changes when a better one starts or when it
    ends, and nowhere else.
    """
    out: list[tuple] = []
    open_: list[tuple] = []
    current, edge = None, 0
    step: tuple | None = None

    def put(at: int, rank: int) -> None:
        """The value from ``at`` on; a later one at the same time replaces it."""
        nonlocal step
        if step is not None and step[0] != at and (not out or out[-1][1] != step[1]):
            out.append(step)
        step = (at, rank)

    def until(at: int) -> None:
        """Lets the best one end, again and again, up to ``at``."""
        while open_ and open_[0][1] <= at:
            end = open_[0][1]
            while open_ and open_[0][1] <= end:
                heapq.heappop(open_)
            if end < edge:
                put(end, open_[0][0] if open_ else -1)

    def finish() -> None:
        nonlocal step
        if current is not None:
            until(edge)
            if step is not None and (not out or out[-1][1] != step[1]):
                out.append(step)
        open_.clear()
        step = None

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("slice", "start", "past", "rank", "edge")]
        for slice_no, start, past, rank, high in zip(*columns):
            if slice_no != current:
                finish()
                if out:
                    yield _steps(out)
                    out = []
                current, edge = slice_no, high
            until(start)
            if rank >= 0:
                heapq.heappush(open_, (rank, past))
            put(start, open_[0][0] if open_ else -1)
        if len(out) > 50_000:
            # The last step stays, to be compared with the next.
            yield _steps(out[:-1])
            out = out[-1:]
    finish()
    yield _steps(out)


def _steps(rows: list[tuple]) -> pa.RecordBatch:
    at, rank = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rank, pa.int64())], names=["at", "rank"])


def best_steps(
    intervals: DataFrame, start: str, end: str, rank: Sequence[str], bounds_per_slice: int = BOUNDS_PER_SLICE,
) -> DataFrame:
    """The best interval as a function of time: ``at`` (microseconds; the value
    holds up to the next ``at``) and ``row``, the interval lowest in ``rank``
    (NULL last) among those open, or NULL.

    Time is cut into slices of about equally many interval bounds. What a slice
    must know of intervals that run right through it is one number; the others
    begin or end in it and are swept with a heap. Each interval is sorted into
    two slices at most, however long it is and however many overlap.
    """
    order = [c for i in range(len(rank)) for c in (f"__n{i}", f"__r{i}")] + ["start", "past", "__tie"]
    row = F.struct(*intervals.columns)
    keyed = intervals.filter(F.col(start) <= F.col(end)).select(
        row.alias("row"), _micros(F.col(start)).alias("start"), (_micros(F.col(end)) + 1).alias("past"),
        F.xxhash64(row).alias("__tie"),
        *[x for i, c in enumerate(rank)
          for x in (F.col(c).isNull().cast("int").alias(f"__n{i}"), F.col(c).alias(f"__r{i}"))])
    cuts: list[int] = []
    if 2 * keyed.count() > bounds_per_slice:
        ranked = position(keyed, order, (), measured(keyed, order, bounds_per_slice), name="rank")
        ranked = stored(ranked.select("rank", "row", "start", "past"), "ranked")
        bounds = ranked.select(F.explode(F.array("start", "past")).alias("at"))
        cuts = sorted({c[0] for c in measured(bounds, ["at"], bounds_per_slice, MAX_SLICES).cuts})
    else:
        ranked = position(keyed, order, (), name="rank").select("rank", "row", "start", "past")
    slices = Slices(cuts=tuple((c,) for c in cuts), types=("bigint",))
    spans = ranked.select("rank", "start", "past", slices.number("start").alias("a"),
                          slices.number(F.col("past") - 1).alias("b"))
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    covers = _covers(spans, len(cuts) + 1) if cuts else np.array([-1])
    edges = pd.DataFrame({"slice": np.arange(len(cuts) + 1), "start": [low, *cuts], "edge": [*cuts, high], "rank": covers})
    edges = intervals.sparkSession.createDataFrame(edges, "slice bigint, start bigint, edge bigint, rank bigint")
    # One row per slice, two at most per interval.
    parts = spans.select("rank", "start", "past", F.explode(F.array_distinct(F.array("a", "b"))).alias("slice"))
    parts = parts.join(edges.select("slice", F.col("start").alias("low"), "edge"), "slice").select(
        "slice", F.greatest("start", "low").alias("start"), "past", "rank", "edge")
    whole = edges.select("slice", "start", F.col("edge").alias("past"), "rank", "edge")
    swept = parts.unionByName(whole).repartition("slice").sortWithinPartitions("slice", "start").mapInArrow(
        _sweep, "at bigint, rank bigint")
    # Before the first bound there is nothing to say.
    return swept.filter(F.col("at") > low).join(ranked.select("rank", "row"), "rank", "left").select("at", "row")


def interval_best(
    points: DataFrame,
    intervals: DataFrame,
    ts: str,
    start: str,
    end: str,
    rank: Sequence[str],
    bounds_per_slice: int = BOUNDS_PER_SLICE,
) -> DataFrame:
    """Each point once, with the covering interval lowest in ``rank`` (NULL
    last), or NULLs. Equal ranks are decided either way, the same for all points.

    The intervals alone are swept, into a function of time with at most two steps
    an interval; points then look up the step they lie on by an as-of join, so
    they are neither multiplied nor put into buckets of time.
    """
    take = intervals.columns
    steps = best_steps(intervals, start, end, rank, bounds_per_slice)
    flat = steps.select(F.timestamp_micros("at").alias("__from"), *[F.col(f"row.{c}").alias(f"__i_{c}") for c in take])
    found = asof_join(points.withColumn("__at", F.col(ts).cast("timestamp")), stored(flat, "steps"), "__at", "__from",
                      take=[f"__i_{c}" for c in take])
    return found.select(*points.columns, *[F.col(f"__i_{c}").alias(c) for c in take])
