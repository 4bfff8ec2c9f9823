"""Counts, means and centred products of many columns in one pass.

Each task reduces its rows to one *triangle*: per pair of columns the number of
rows where both are present, both means over those rows, and the centred
product. Triangles merge pairwise (so a large offset never costs digits, and no
second pass for the means is needed) and can be taken away again, so figures
kept per day give those of any stretch of days.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Triangles merged by one task on the way to the driver.
_MERGED = 32
_FIELDS = "n array<double>, a array<double>, b array<double>, c array<double>"


@dataclass(frozen=True)
class Triangle:
    """Packed upper triangle: rows ``n``, means ``a`` (row column) and ``b``
    (column column), centred products ``c``."""

    n: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray

    @staticmethod
    def empty(k: int) -> Triangle:
        return Triangle(*(np.zeros(k * (k + 1) // 2) for _ in range(4)))

    @staticmethod
    def of(x: np.ndarray) -> Triangle:
        """Of rows; NaN is missing."""
        k = x.shape[1]
        seen = ~np.isnan(x)
        held = seen.sum(axis=0)
        shift = np.where(seen, x, 0.0).sum(axis=0) / np.maximum(held, 1)
        z = np.where(seen, x - shift, 0.0)
        seen = seen.astype(float)
        n, s, q = seen.T @ seen, z.T @ seen, z.T @ z
        mean = s / np.maximum(n, 1.0)
        up = np.triu_indices(k)
        return Triangle(n[up], (shift[:, None] + mean)[up], (shift[None, :] + mean.T)[up], (q - s * mean.T)[up])

    def plus(self, other: Triangle) -> Triangle:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1.0)
        da, db = other.a - self.a, other.b - self.b
        return Triangle(n, self.a + da * share, self.b + db * share, self.c + other.c + da * db * self.n * share)

    def minus(self, other: Triangle) -> Triangle:
        """What is left when rows are taken away that are part of it."""
        n = self.n - other.n
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        a, b = self.a + (self.a - other.a) * share, self.b + (self.b - other.b) * share
        c = self.c - other.c - (other.a - a) * (other.b - b) * n * other.n / np.maximum(self.n, 1.0)
        some = n > 0
        return Triangle(n, *(np.where(some, x, 0.0) for x in (a, b, c)))

    def square(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, mean of each column, products divided by n) as full matrices."""
        n, c = np.zeros((k, k)), np.zeros((k, k))
        up = np.triu_indices(k)
        n[up], c[up] = self.n, self.c / np.maximum(self.n, 1.0)
        n, c = np.maximum(n, n.T), c + np.triu(c, 1).T
        own = np.cumsum([0, *range(k, 1, -1)])[:k]
        return n, self.a[own], c


def _prepared(df: DataFrame, names: Sequence[str], missing: str, keep: Sequence[str] = ()) -> DataFrame:
    if missing not in ("listwise", "pairwise"):
        raise ValueError("missing must be 'listwise' or 'pairwise'")
    cols = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(names)]
    data = df.select(*keep, *cols)
    return data.dropna(subset=[f"v{i}" for i in range(len(names))]) if missing == "listwise" else data


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.column_stack([
        batch.column(f"v{i}").fill_null(np.nan).to_numpy(zero_copy_only=False) for i in range(k)])


def _merged(frame: pd.DataFrame, k: int) -> Triangle:
    total = Triangle.empty(k)
    for row in frame.itertuples():
        total = total.plus(Triangle(*(np.asarray(getattr(row, x), dtype=float) for x in "nabc")))
    return total


def triangle(df: DataFrame, names: Sequence[str], missing: str = "listwise") -> Triangle:
    """Of all rows of ``df``, read once. ``listwise`` uses rows where every column
    is present, ``pairwise`` for each pair the rows where both are; NaN counts as
    missing."""
    k = len(names)

    def reduce_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Triangle.empty(k)
        for batch in batches:
            if batch.num_rows:
                total = total.plus(Triangle.of(_matrix(batch, k)))
        if total.n.any():
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(),
                                               **{x: getattr(total, x).tolist() for x in "nabc"}}])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = _merged(frame.sort_values("part"), k)
        return pd.DataFrame({"part": [int(frame["part"].min())], **{x: [getattr(total, x)] for x in "nabc"}})

    fields = f"part bigint, {_FIELDS}"
    rows = _prepared(df, names, missing).mapInArrow(reduce_task, fields)
    rows = rows.groupBy(F.floor(F.col("part") / _MERGED)).applyInPandas(merge, fields)
    return _merged(rows.toPandas().sort_values("part"), k)


def daily_triangles(df: DataFrame, names: Sequence[str], ts: str, missing: str = "listwise") -> DataFrame:
    """One row per day: ``day`` and its triangle (``n``, ``a``, ``b``, ``c``)."""
    k = len(names)

    def reduce_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One triangle per day met; a day may come in several tasks."""
        held: dict[int, Triangle] = {}
        for batch in batches:
            day = batch.column("day").cast(pa.int32()).to_numpy()
            x = _matrix(batch, k)
            for d in np.unique(day):
                part = Triangle.of(x[day == d])
                held[int(d)] = held[int(d)].plus(part) if int(d) in held else part
        for d, t in sorted(held.items()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()).cast(pa.date32()), pa.array([TaskContext.get().partitionId()], pa.int32()),
                 *[pa.array([getattr(t, x)], pa.list_(pa.float64())) for x in "nabc"]],
                names=["day", "part", "n", "a", "b", "c"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = _merged(frame.sort_values("part"), k)
        return pd.DataFrame({"day": [frame["day"].iloc[0]], **{x: [getattr(total, x)] for x in "nabc"}})

    rows = _prepared(df.withColumn("day", F.to_date(ts)), names, missing, ["day"]).filter("day IS NOT NULL")
    return rows.mapInArrow(reduce_task, f"day date, part int, {_FIELDS}").groupBy("day").applyInPandas(
        merge, f"day date, {_FIELDS}")


def moving(daily: DataFrame, k: int, days: int) -> Iterator[tuple]:
    """(day, triangle of the ``days`` days up to it) for every day of a table of
    daily triangles. A day is added and one taken away at each step; after every
    ``days`` steps the sum is made afresh, so rounding does not build up."""
    rows = daily.toPandas().sort_values("day")  # one row per day
    kept: list[tuple] = []
    total, steps = Triangle.empty(k), 0
    for row in rows.itertuples():
        new = Triangle(*(np.asarray(getattr(row, x), dtype=float) for x in "nabc"))
        kept.append((row.day, new))
        total, steps = total.plus(new), steps + 1
        while (row.day - kept[0][0]).days >= days:
            total = total.minus(kept.pop(0)[1])
        if steps >= days:
            total, steps = Triangle.empty(k), 0
            for _, t in kept:
                total = total.plus(t)
        yield row.day, total
