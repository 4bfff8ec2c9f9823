"""Splitting an ordered stream into pieces that fit one task.

A window over ``partitionBy(key)`` puts all rows of a key into one task, and
without a key it puts the whole table there. Here the ordered rows are cut into
*slices* first, so a key (or the whole table) spreads over many tasks. What one
slice must know of the earlier ones is a single carried row, worked out from a
map-side combined aggregate that has one row per (key, slice).

Two ways to cut:

* ``measured`` draws a small sample of the order columns, as Spark's own range
  partitioner does, and cuts at its quantiles. The cuts only steer the balance,
  never the result. Because a cut is a tuple of order columns, even rows that
  share one timestamp are split as long as a later order column tells them
  apart. Inputs below ``rows_per_slice`` get no cuts and keep a plain window.
* ``every`` cuts at a fixed width of time, which needs no look at the data and
  suits regular grids.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SLICE = 1_000_000
# Cuts drawn from the sample. More slices than that divide the stretches between
# cuts evenly, so their number follows the rows.
MAX_CUTS = 2_000
SAMPLE_PER_SLICE = 20

_CELLS_PER_CUT = 4
_CUTS_PER_CELL = 4
_TIMES = ("timestamp", "timestamp_ntz", "date")
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _whole(col: Column, kind: str) -> Column:
    """Order-keeping whole number of the leading order column."""
    if kind in _TIMES:
        return F.unix_micros(col.cast("timestamp"))
    return F.floor(col).cast("bigint")


def _longs(values: Sequence[int]) -> Column:
    """A constant array made from one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


@dataclass(frozen=True)
class Slices:
    """How to number the slice of a row from its order columns.

    A cut is (whole number of the leading column, further order values as
    text); ``types`` are the types of the order columns.
    """

    cuts: tuple[tuple, ...] = ()
    types: tuple[str, ...] = ()
    width_seconds: int | None = None
    parts: int = 1

    @property
    def split(self) -> bool:
        return bool(self.cuts) or self.width_seconds is not None

    def number(self, *order: str | Column) -> Column:
        """Slice number of the row; it never falls along the order."""
        cols = [F.col(c) if isinstance(c, str) else c for c in order]
        if self.width_seconds is not None:
            seconds = F.unix_timestamp(cols[0].cast("timestamp"))
            return F.floor(seconds / self.width_seconds).cast("long")
        if not self.cuts:
            return F.lit(0).cast("long")
        found = F.coalesce(self._by_cell(cols), F.lit(0)).cast("long")
        return found if self.parts == 1 else found * self.parts + self._part(cols[0], found)

    def _part(self, col: Column, found: Column) -> Column:
        """Part of the stretch between two cuts, by the leading column."""
        lead = [c[0] for c in self.cuts]
        v, at = _whole(col, self.types[0]), found.cast("int")
        low, high = F.get(_longs([lead[0], *lead]), at), F.get(_longs([*lead, lead[-1]]), at)
        share = (v - low) / F.greatest(high - low, F.lit(1)).cast("double")
        inside = F.least(F.greatest(F.floor(share * self.parts), F.lit(0)), F.lit(self.parts - 1))
        return F.coalesce(inside, F.lit(0)).cast("long")

    def _by_cell(self, cols: Sequence[Column]) -> Column:
        """Cells of equal width hold a few cuts each, kept as constant arrays:
        cuts before the cell plus those of the cell that lie at or before the
        row. A cell crowded with cuts, or with several at one value, searches
        the cuts by all order columns instead.
        """
        lead = [c[0] for c in self.cuts]
        low, high = lead[0], lead[-1]
        cells = len(lead) * _CELLS_PER_CUT
        width = max(1, (high - low) // cells + 1)
        cells = (high - low) // width + 1
        held: list[list[int]] = [[] for _ in range(cells)]
        for c in lead:
            held[(c - low) // width].append(c)
        crowded = [len(h) > _CUTS_PER_CELL or len(set(h)) < len(h) for h in held]
        before, n = [], 0
        for h in held:
            before.append(n)
            n += len(h)

        v = _whole(cols[0], self.types[0])
        cell = F.least(F.greatest(F.floor((v - low) / width), F.lit(-1)), F.lit(cells - 1)).cast("int")
        found = F.get(_longs(before), cell)
        most = max((len(h) for h, x in zip(held, crowded) if not x), default=0)
        for j in range(most):
            nth = _longs([h[j] if j < len(h) and not x else 0 for h, x in zip(held, crowded)])
            real = _longs([int(j < len(h) and not x) for h, x in zip(held, crowded)])
            here = (F.get(real, cell) == 1) & (v >= F.get(nth, cell))
            found = found + F.when(here, 1).otherwise(0)
        if any(crowded):
            found = F.when(
                F.get(_longs([int(x) for x in crowded]), cell) == 1, self._search(cols)
            ).otherwise(found)
        return F.when(cell < 0, 0).otherwise(found)

    def _search(self, cols: Sequence[Column]) -> Column:
        """Binary search over the whole cuts: how many are <= row."""

        def point(values):
            return F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)])

        here = point([_whole(cols[0], self.types[0]), *cols[1 : len(self.types)]])
        cuts = F.array(*[
            point([F.lit(cut[0]).cast("bigint"),
                   *[F.lit(x).cast(t) for x, t in zip(cut[1:], self.types[1:])]])
            for cut in self.cuts
        ])
        jumps = [1 << b for b in reversed(range(len(self.cuts).bit_length()))]
        return F.aggregate(
            F.array(*[F.lit(j) for j in jumps]),
            F.lit(0),
            lambda at, jump: F.when(F.get(cuts, at + jump - 1) <= here, at + jump).otherwise(at),
        ).cast("long")


WHOLE = Slices()


def every(seconds: int) -> Slices:
    """Fixed-width slices of time."""
    return Slices(width_seconds=int(seconds))


def measured(
    df: DataFrame,
    order: Sequence[str],
    rows_per_slice: int = ROWS_PER_SLICE,
    max_cuts: int = MAX_CUTS,
) -> Slices:
    """Cuts at the sampled quantiles of ``order``.

    The leading order column must be a time or a number. At most about
    ``SAMPLE_PER_SLICE * max_cuts`` sampled values come to the driver,
    whatever the size of ``df``. Further order columns are only sampled when
    some value of the leading one is so common that cuts fall together on it.
    """
    kinds = [df.schema[c].dataType.simpleString() for c in order]
    if kinds[0] not in _TIMES + _NUMBERS:
        raise ValueError(f"cannot cut by {order[0]!r} of type {kinds[0]}")
    lead = df.select(_whole(F.col(order[0]), kinds[0]).alias("v")).dropna()
    rows = lead.count()
    slices = rows // max(1, rows_per_slice)
    wanted = min(max_cuts, slices)
    if wanted < 1:
        return WHOLE
    fraction = min(1.0, SAMPLE_PER_SLICE * (wanted + 1) / rows)

    def quantiles(found: list) -> list:
        found = sorted(found)
        at = [len(found) * (i + 1) // (wanted + 1) for i in range(wanted)]
        return [found[i] for i in at if i < len(found)]

    cuts = quantiles([(r.v,) for r in lead.sample(fraction=fraction, seed=11).collect()])
    if len(order) > 1 and len(set(cuts)) < len(cuts):
        full = df.select(_whole(F.col(order[0]), kinds[0]).alias("v"), *order[1:]).dropna()
        cuts = quantiles([tuple(r) for r in full.sample(fraction=fraction, seed=11).collect()])
        cuts = [(c[0], *map(str, c[1:])) for c in cuts]
    else:
        kinds = kinds[:1]
    return Slices(cuts=tuple(dict.fromkeys(cuts)), types=tuple(kinds), parts=-(-slices // wanted))
