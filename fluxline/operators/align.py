"""Alignment of two long ordered logs: what was changed, removed, inserted, moved.

Entries whose content stands once in either log are *anchors*. The longest run
of anchors in the same order on both sides is kept; everything else lies in the
gaps between them and is settled there.

The longest run is found without putting a log into one task. An anchor whose
place is above all before it and below all after it belongs to every longest
run (two running extremes, carried from slice to slice, tell which). Such
anchors cut the log into stretches that are independent of each other, and only
anchors inside a stretch that are out of order need the quadratic-free search
of :func:`longest_run`; there are as many as entries were moved about.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxline.operators.ordered import position, running
from fluxline.operators.slices import ROWS_PER_SLICE, measured
from fluxline.session import stored


def longest_run(places: Sequence[int]) -> list[int]:
    """Indices of a longest increasing subsequence of distinct numbers."""
    tails: list[int] = []
    at: list[int] = []
    before = np.full(len(places), -1, dtype=np.int64)
    for i, p in enumerate(places):
        j = bisect_left(tails, p)
        before[i] = at[j - 1] if j else -1
        if j == len(tails):
            tails.append(p)
            at.append(i)
        else:
            tails[j], at[j] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = int(before[i])
    return out[::-1]


def _kept_anchors(anchors: DataFrame, keys: list[str], rows_per_slice: int) -> DataFrame:
    """``keys``, ``e``, ``a`` of the anchors on a longest common run of each log."""
    cut = measured(anchors, ["e"], rows_per_slice)
    seen = running(anchors, ["e"], "a", keys, cut, "__below")
    seen = running(seen, ["e"], "a", keys, cut, "__above", how=F.min, backward=True)
    fixed = (F.coalesce(F.col("__below") < F.col("a"), F.lit(True))
             & F.coalesce(F.col("a") < F.col("__above"), F.lit(True)))
    seen = seen.withColumn("__fixed", fixed.cast("long"))
    seen = stored(running(seen, ["e"], "__fixed", keys, cut, "__stretch", how=F.sum), "anchors")
    loose = seen.filter("__fixed = 0").select(*keys, F.coalesce("__stretch", F.lit(0)).alias("__stretch"), "e", "a")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("e")
        return group.iloc[longest_run(group["a"].tolist())][[*keys, "e", "a"]]

    fixed_ones = seen.filter("__fixed = 1").select(*keys, "e", "a")
    found = loose.groupBy(*keys, "__stretch").applyInPandas(run, fixed_ones.schema)
    return fixed_ones.unionByName(found)


def _gaps(rows: DataFrame, kept: DataFrame, keys: list[str], place: str, rows_per_slice: int) -> DataFrame:
    """Rows that are no kept anchor, with ``__gap``, the anchors before them."""
    # Places alone are counted through; contents follow for the few rows that are left.
    marked = rows.select(*keys, place).join(
        kept.select(*keys, place, F.lit(1).cast("long").alias("__hit")), [*keys, place], "left")
    marked = marked.withColumn("__hit", F.coalesce("__hit", F.lit(0)))
    # The join keeps every row once, so the rows themselves say where to cut.
    cut = measured(rows, [place], rows_per_slice)
    placed = running(marked, [place], "__hit", keys, cut, "__gap", how=F.sum)
    free = placed.filter("__hit = 0").withColumn("__gap", F.coalesce("__gap", F.lit(0))).drop("__hit")
    free = stored(free, "gap-places").withColumnsRenamed({c: f"__{c}" for c in [*keys, place]})
    # A null key is a log too.
    same = [rows[c].eqNullSafe(free[f"__{c}"]) for c in [*keys, place]]
    return rows.join(free, same).select(*rows.columns, "__gap")


def _paired(e: DataFrame, a: DataFrame, on: list[str], rows_per_slice: int) -> DataFrame:
    """The n-th left row of a value of ``on`` beside the n-th right row, in full."""
    sides = []
    for rows, place in ((e, "e"), (a, "a")):
        numbered = position(rows, [place], on, measured(rows, [place], rows_per_slice), name="__nth",
                            total="__n", first="__lo", last="__hi")
        sides.append(numbered.drop("__n", "__lo", "__hi"))
    return sides[0].join(sides[1], [*on, "__nth"], "full_outer").drop("__nth")


def differences(
    expected: DataFrame,
    actual: DataFrame,
    keys: Sequence[str],
    seq: str,
    entry_id: str,
    content: str,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per entry that is not the same on both sides.

    Both sides have ``keys`` (the log), ``seq`` (whole number, unique in its
    log), ``entry_id`` and ``content`` (a digest). The result has ``keys``,
    ``kind``, ``expected_seq``, ``actual_seq``, ``entry_id``,
    ``expected_content`` and ``actual_content``. Kinds, in the order in which
    entries of a gap are settled: equal contents are the same entry; equal ids
    are ``changed``; equal contents elsewhere in the log are ``moved``; the rest
    is ``removed`` or ``inserted``. Repeated contents or ids pair off in order.
    """
    keys = list(keys)
    e = expected.select(*keys, F.col(seq).cast("long").alias("e"), F.col(entry_id).alias("e_id"),
                        F.col(content).alias("c"))
    a = actual.select(*keys, F.col(seq).cast("long").alias("a"), F.col(entry_id).alias("a_id"),
                      F.col(content).alias("c"))

    # Both are read several times; their numbering is worked out once.
    e, a = stored(e, "expected"), stored(a, "actual")

    def once(rows: DataFrame, place: str) -> DataFrame:
        return rows.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias(place)).filter(
            "n = 1").drop("n")

    anchors = stored(once(e, "e").join(once(a, "a"), [*keys, "c"]).select(*keys, "e", "a"), "anchors")
    kept = stored(_kept_anchors(anchors, keys, rows_per_slice), "kept-anchors")
    e_left = stored(_gaps(e, kept, keys, "e", rows_per_slice), "expected-gaps")
    a_left = stored(_gaps(a, kept, keys, "a", rows_per_slice), "actual-gaps")

    def split(both: DataFrame, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        both = stored(both, label)
        return (both.filter("e IS NOT NULL AND a IS NOT NULL"), both.filter("a IS NULL"), both.filter("e IS NULL"))

    # Equal contents in a gap are the same entry.
    _, e_rest, a_rest = split(_paired(e_left, a_left, [*keys, "__gap", "c"], rows_per_slice), "same")
    e_rest = e_rest.select(*keys, "__gap", "e", "e_id", F.col("c").alias("e_c"))
    a_rest = a_rest.select(*keys, "__gap", "a", "a_id", F.col("c").alias("a_c"))
    by_id = _paired(e_rest.withColumn("id", F.col("e_id")), a_rest.withColumn("id", F.col("a_id")),
                    [*keys, "__gap", "id"], rows_per_slice)
    changed, e_rest, a_rest = split(by_id, "changed")
    e_rest = e_rest.select(*keys, "e", "e_id", "e_c", F.col("e_c").alias("c"))
    a_rest = a_rest.select(*keys, "a", "a_id", "a_c", F.col("a_c").alias("c"))
    rest = _paired(e_rest, a_rest, [*keys, "c"], rows_per_slice)
    kind = F.when(F.col("a").isNull(), "removed").when(F.col("e").isNull(), "inserted").otherwise("moved")
    names = [*keys, "kind", "e", "a", "e_id", "a_id", "e_c", "a_c"]
    found = changed.withColumn("kind", F.lit("changed")).select(names).unionByName(
        rest.withColumn("kind", kind).select(names))
    return found.select(
        *keys, "kind", F.col("e").alias("expected_seq"), F.col("a").alias("actual_seq"),
        F.coalesce("e_id", "a_id").alias("entry_id"), F.col("e_c").alias("expected_content"),
        F.col("a_c").alias("actual_content"))
