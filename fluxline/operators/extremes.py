"""Extremes of points inside many time windows at once.

Points are cut into slices of time. A window then consists of an end of one
slice, a beginning of another, and whole slices in between. Both levels answer
by range-extreme tables: for every power of two the extreme of that many
neighbours, so that any stretch is covered by two overlapping entries and
costs two look-ups. Rows shuffled are the points once and two per window,
however long windows are and however many overlap; no row is made for a pair
of a point and a window.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxline.operators.slices import Slices, measured
from fluxline.session import stored

ROWS_PER_SLICE = 100_000
# At most so many slices; the driver sees one row for each.
MAX_SLICES = 20_000

_NONE = -np.inf


def extreme_table(values: np.ndarray) -> list[np.ndarray]:
    """Row k holds the maxima of 2**k neighbours from each place on; columns are
    worked out side by side."""
    rows, width = [values], 1
    while 2 * width <= len(values):
        last = rows[-1]
        rows.append(np.maximum(last[:-width], last[width:]))
        width *= 2
    return rows


def look_up(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Maxima of the stretches [first, last]; -inf for those that are empty."""
    out = np.full((len(first), table[0].shape[1]), _NONE)
    size = last - first + 1
    power = np.where(size > 0, np.frexp(np.maximum(size, 1).astype(float))[1] - 1, -1)
    for k in np.unique(power[power >= 0]):
        hit = power == k
        out[hit] = np.maximum(table[k][first[hit]], table[k][last[hit] - (1 << int(k)) + 1])
    return out


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def extremes_in_windows(
    points: DataFrame,
    windows: DataFrame,
    ts: str,
    start: str,
    end: str,
    values: Mapping[str, tuple[str | Column, str]],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Every window with the extremes of the points in [start, end].

    ``values`` names the results: ``{"bz_min": ("bz", "min")}``. Missing values
    (NULL, NaN) are passed over; a window without any, or whose end comes before
    its start, gets NULL. Results are doubles.
    """
    if any(kind not in ("min", "max") for _, kind in values.values()):
        raise ValueError("an extreme is 'min' or 'max'")
    names = [f"v{i}" for i in range(len(values))]
    # Minima are maxima of the negative; one row per time is enough.
    sign = [1.0 if kind == "max" else -1.0 for _, kind in values.values()]
    cols = [F.nanvl((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(None).cast("double"))
            for c, _ in values.values()]
    rows = points.select(_micros(F.col(ts)).alias("t"), *[(c * s).alias(n) for c, s, n in zip(cols, sign, names)])
    rows = rows.filter(F.col("t").isNotNull()).groupBy("t").agg(*[F.max(n).alias(n) for n in names])
    rows = stored(rows, "points")
    cuts = sorted({c[0] for c in measured(rows, ["t"], rows_per_slice, MAX_SLICES).cuts})
    slices = Slices(cuts=tuple((c,) for c in cuts), types=("bigint",))
    rows = rows.withColumn("slice", slices.number("t"))

    # The windows get a number that stays the same when they are read again.
    held = stored(windows.withColumn("__w", F.monotonically_increasing_id()), "windows")
    asks = held.select("__w", _micros(F.col(start)).alias("lo"), _micros(F.col(end)).alias("hi")).filter("lo <= hi")
    asks = asks.withColumn("a", slices.number("lo")).withColumn("b", slices.number("hi"))
    ends = asks.select("__w", "lo", "hi", F.explode(F.array_distinct(F.array("a", "b"))).alias("slice"))

    fields = ", ".join(f"{n} double" for n in names)
    blank = [F.lit(None).cast("double").alias(n) for n in names]
    mixed = rows.select("slice", F.lit(0).alias("kind"), "t", F.lit(None).cast("bigint").alias("hi"),
                        F.lit(None).cast("bigint").alias("__w"), *names).unionByName(
        ends.select("slice", F.lit(1).alias("kind"), F.col("lo").alias("t"), "hi", "__w", *blank))

    def packed(w: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        hit = (found > _NONE).any(axis=1)
        arrays = [pa.array(w[hit], pa.int64())]
        for column in found[hit].T:
            arrays.append(pa.array(column, pa.float64(), mask=column == _NONE))
        return pa.RecordBatch.from_arrays(arrays, names=["__w", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per slice its points in order, then its windows."""
        current, times, held_values, table = None, [], [], None
        t_all = np.empty(0, dtype=np.int64)
        for batch in batches:
            number = batch.column("slice").to_numpy()
            kind = batch.column("kind").to_numpy()
            t = batch.column("t").to_numpy()
            # Stretches of one slice and kind.
            edge = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *edge], [*edge, len(number)]):
                if i == j:
                    continue
                if number[i] != current:
                    current, times, held_values, table = number[i], [], [], None
                part = batch.slice(int(i), int(j - i))
                if kind[i] == 0:
                    times.append(t[i:j])
                    held_values.append(np.column_stack([
                        part.column(n).fill_null(_NONE).to_numpy(zero_copy_only=False) for n in names]))
                    continue
                if not times:
                    continue
                if table is None:
                    t_all, table = np.concatenate(times), extreme_table(np.concatenate(held_values))
                first = np.searchsorted(t_all, t[i:j], "left")
                last = np.searchsorted(t_all, part.column("hi").to_numpy(zero_copy_only=False), "right") - 1
                yield packed(part.column("__w").to_numpy(zero_copy_only=False), look_up(table, first, last))

    found = mixed.repartition("slice").sortWithinPartitions("slice", "kind", "t").mapInArrow(run, f"__w bigint, {fields}")
    if len(cuts) > 1:
        tops = np.full((len(cuts) + 1, len(names)), _NONE)
        for r in rows.groupBy("slice").agg(*[F.max(n).alias(n) for n in names]).collect():
            tops[r.slice] = [_NONE if r[n] is None else r[n] for n in names]
        whole = extreme_table(tops)

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
                yield packed(batch.column("__w").to_numpy(), look_up(whole, a + 1, b - 1))

        found = found.unionByName(asks.filter("b > a + 1").select("__w", "a", "b").mapInArrow(
            between, f"__w bigint, {fields}"))
    best = found.groupBy("__w").agg(*[F.max(n).alias(n) for n in names])
    return held.join(best, "__w", "left").select(
        *windows.columns, *[(F.col(n) * s).alias(name) for n, s, name in zip(names, sign, values)])
