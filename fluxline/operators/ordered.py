"""Row-to-row operators over an ordered stream, free of one-task windows.

Each operator adds one *head* row in front of every (key, slice). The head
carries what the slice needs from earlier slices; it is dropped at the end.
With unsplit slices no head is needed and the plan is a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxline.operators.slices import WHOLE, Slices

_SLICE, _HEAD, _CARRY, _BODY = "__slice", "__head", "__carry", "__body"


def _asc(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def with_heads(
    df: DataFrame,
    keys: Sequence[str],
    slice_no: Column,
    gather: dict[str, Column],
    carry: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Rows of ``df`` plus one head row per (key, slice).

    ``gather`` are the aggregates of one (key, slice); ``carry`` are window
    expressions over the gathered rows, written against the window that
    :func:`gathered` gives. The result has ``__body`` (the row, null on heads),
    ``__carry`` (null on bodies) and ``__head``.
    """
    body = df.select(
        *[F.col(k) for k in keys],
        slice_no.alias(_SLICE),
        F.struct(*df.columns).alias(_BODY),
    )
    heads = (
        df.groupBy(*keys, slice_no.alias(_SLICE))
        .agg(*[v.alias(k) for k, v in gather.items()])
        .select(
            *keys,
            _SLICE,
            F.struct(*[v.alias(k) for k, v in carry.items()]).alias(_CARRY),
        )
    )
    marked = body.withColumn(_HEAD, F.lit(False)).unionByName(
        heads.withColumn(_HEAD, F.lit(True)), allowMissingColumns=True
    )
    return marked


def gathered(keys: Sequence[str], descending: bool = False):
    """Window over the gathered (key, slice) rows; one row per slice of a key."""
    order = F.col(_SLICE).desc() if descending else F.col(_SLICE).asc()
    return Window.partitionBy(*keys).orderBy(order)


def within(keys: Sequence[str], order: Sequence[str], descending: bool = False):
    """Window inside one (key, slice), head first."""
    return Window.partitionBy(*keys, _SLICE).orderBy(
        F.col(_HEAD).desc(), *[
            F.col(f"{_BODY}.{c}").desc() if descending else F.col(f"{_BODY}.{c}").asc()
            for c in order
        ]
    )


def neighbour(
    df: DataFrame,
    order: Sequence[str],
    take: dict[str, str],
    keys: Sequence[str] = (),
    forward: bool = False,
    slices: Slices = WHOLE,
) -> DataFrame:
    """Adds columns of the row before (or after, ``forward``) in ``order``.

    ``take`` maps a source column to the name it gets; the first (last) row of
    a key gets NULL. ``order`` should be unique within a key.
    """
    picked = F.struct(*[F.col(c) for c in take])
    if not slices.split:
        w = Window.partitionBy(*keys).orderBy(*_asc(order, forward))
        near = df.withColumn("__near", F.lag(picked).over(w))
    else:
        number = slices.number(*order)
        place = F.struct(*order)
        edge = (F.min_by if forward else F.max_by)(picked, place)
        marked = with_heads(
            df, keys, number,
            gather={"edge": edge},
            carry={"near": F.lag("edge").over(gathered(keys, forward))},
        )
        w = within(keys, order, forward)
        own = F.struct(*[F.col(f"{_BODY}.{c}") for c in take])
        seen = F.when(F.col(_HEAD), F.col(f"{_CARRY}.near")).otherwise(own)
        near = (
            marked.withColumn("__near", F.lag(seen).over(w))
            .filter(~F.col(_HEAD))
            .select(f"{_BODY}.*", "__near")
        )
    return near.select(
        *df.columns, *[F.col(f"__near.{c}").alias(n) for c, n in take.items()]
    )


def position(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    slices: Slices = WHOLE,
    name: str = "position",
    total: str = "total",
    first: str = "first",
    last: str = "last",
) -> DataFrame:
    """Adds the 0-based index in its key, the key's row count, and the first
    and last value of ``order[0]`` in the key.
    """
    lead = order[0]
    gather = {"n": F.count(F.lit(1)), "lo": F.min(lead), "hi": F.max(lead)}
    if not slices.split:
        w = Window.partitionBy(*keys).orderBy(*_asc(order, False))
        whole = Window.partitionBy(*keys)
        return df.select(
            "*",
            (F.row_number().over(w) - 1).cast("long").alias(name),
            F.count(F.lit(1)).over(whole).alias(total),
            F.min(lead).over(whole).alias(first),
            F.max(lead).over(whole).alias(last),
        )
    g = gathered(keys)
    before = g.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    marked = with_heads(
        df, keys, slices.number(*order), gather,
        carry={
            "skip": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "n": F.sum("n").over(whole),
            "lo": F.min("lo").over(whole),
            "hi": F.max("hi").over(whole),
        },
    )
    w = within(keys, order)
    head = F.first(_CARRY, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.withColumn("__h", head)
        .withColumn("__rn", F.row_number().over(w))
        .filter(~F.col(_HEAD))
        .select(
            f"{_BODY}.*",
            (F.col("__rn") - 2 + F.col("__h.skip")).cast("long").alias(name),
            F.col("__h.n").alias(total),
            F.col("__h.lo").alias(first),
            F.col("__h.hi").alias(last),
        )
    )


def running(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    keys: Sequence[str] = (),
    slices: Slices = WHOLE,
    name: str = "running",
    how=F.max,
    backward: bool = False,
) -> DataFrame:
    """Adds ``how`` (max, min or sum) of ``value`` over the rows of the key that
    come before in ``order`` (after it with ``backward``), the row itself left
    out; NULL where there is none. ``order`` should be unique within a key."""
    if not slices.split:
        w = Window.partitionBy(*keys).orderBy(*_asc(order, backward)).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, how(value).over(w))
    before = gathered(keys, backward).rowsBetween(Window.unboundedPreceding, -1)
    marked = with_heads(
        df, keys, slices.number(*order), gather={"v": how(value)}, carry={"v": how("v").over(before)})
    w = within(keys, order, backward).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col(_HEAD), F.col(f"{_CARRY}.v")).otherwise(F.col(f"{_BODY}.{value}"))
    return marked.withColumn(name, how(seen).over(w)).filter(~F.col(_HEAD)).select(f"{_BODY}.*", name)


def last_k(
    df: DataFrame, order: Sequence[Column], k: int, keys: Sequence[str]
) -> DataFrame:
    """First ``k`` rows of each key in ``order`` (pass descending columns for
    the newest). Spark prunes to ``k`` rows per key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")
