"""Joins on keys of which a few hold most rows.

A mergeable sketch finds the heavy keys in one pass and without a shuffle; their
rows are then dealt to many tasks and the few matching rows of the other side
are copied to each of them. All other keys join as ever. A right side of a
counted, small size is broadcast instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys with at least this share of the rows are heavy.
SHARE = 0.005
# Right sides up to this many rows and bytes of text are broadcast.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 4_000_000
# Pieces of a key with all rows, per shuffle partition: so many that the pieces
# a partition gets by chance hardly differ in number.
PIECES = 64
_MERGED = 32


def trimmed(counts: dict, size: int) -> dict:
    """The counters of a Misra-Gries sketch of ``size``: what is beyond the
    largest ``size`` is taken off all of them."""
    if len(counts) <= size:
        return counts
    off = sorted(counts.values(), reverse=True)[size]
    return {k: n - off for k, n in counts.items() if n > off}


def heavy_keys(df: DataFrame, key: Column, share: float = SHARE) -> dict[str | None, int]:
    """Keys (as text) that may have ``share`` of the rows or more, with a count
    that is low by at most half of that share. None is missed.

    Tasks keep ``2 / share`` counters each; sketches merge by adding counters and
    trimming, on the way to the driver too.
    """
    size = max(1, int(2 / share))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for x in batch.column("k").value_counts():
                k, n = x["values"].as_py(), x["counts"].as_py()
                counts[k] = counts.get(k, 0) + n
            counts = trimmed(counts, size)
        if rows:
            part = TaskContext.get().partitionId()
            # The first row tells how many rows there were.
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * (len(counts) + 1), pa.int64()), pa.array([True] + [False] * len(counts)),
                 pa.array([None, *counts], pa.string()), pa.array([rows, *counts.values()], pa.int64())],
                names=["part", "whole", "k", "n"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        rows, counts = _added(frame, size)
        return pd.DataFrame({"part": 0, "whole": [True] + [False] * len(counts), "k": [None, *counts],
                             "n": [rows, *counts.values()]})

    fields = "part bigint, whole boolean, k string, n bigint"
    found = df.select(key.cast("string").alias("k")).mapInArrow(sketch, fields)
    merged = found.groupBy(F.floor(F.col("part") / _MERGED)).applyInPandas(merge, fields)
    rows, counts = _added(merged.toPandas(), size)
    return {k: n for k, n in counts.items() if n >= rows * share / 2}


def _added(frame: pd.DataFrame, size: int) -> tuple[int, dict]:
    rows, counts = 0, {}
    for whole, k, n in zip(frame["whole"], frame["k"], frame["n"]):
        if whole:
            rows += int(n)
        else:
            counts[k] = counts.get(k, 0) + int(n)
    return rows, trimmed(counts, size)


def _key_text(on: Sequence[str]) -> Column:
    """One text per key; NULL keys, which join with nothing, give NULL."""
    whole = F.col(on[0]).isNotNull()
    for c in on[1:]:
        whole = whole & F.col(c).isNotNull()
    return F.when(whole, F.to_json(F.struct(*on)))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """The table has at most so many rows and bytes (as JSON); reads no more than
    one row beyond."""
    text = F.octet_length(F.to_json(F.struct(*df.columns)))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes")).first()
    return found.n <= rows and found.bytes <= size


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    share: float = SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """``left.join(right, on, how)`` for ``inner`` and ``left`` that holds up when a
    few keys have most of the left rows.

    A heavy key's left rows are dealt by a hash of ``spread`` (all columns by
    default; rows equal in them stay together), into as many pieces as its share
    asks for, but never so many that copies of its right rows outnumber them.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, got {how!r}")
    on = list(on)
    if small(right, broadcast_rows):
        return left.join(F.broadcast(right), on, how)
    heavy = {k: n for k, n in heavy_keys(left, _key_text(on), share).items() if k is not None}
    if not heavy:
        return left.join(right, on, how)
    text = _key_text(on)
    # At most one number per heavy key.
    matches = {r.k: r.n for r in right.select(text.alias("k")).filter(F.col("k").isin(list(heavy))).groupBy("k").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    total = sum(heavy.values())
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = {k: max(1, min(-(-n * PIECES * tasks // total), n // max(1, matches.get(k, 1)))) for k, n in heavy.items()}
    table = F.from_json(F.lit(json.dumps(pieces)), "map<string,int>")
    n = F.coalesce(F.element_at(table, text), F.lit(1))
    dealt = left.withColumn("__piece", F.pmod(F.xxhash64(*(spread or left.columns)), n.cast("bigint")).cast("int"))
    copied = right.withColumn("__piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.join(copied, [*on, "__piece"], how).drop("__piece")
