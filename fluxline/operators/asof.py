"""As-of join: for each left row the nearest right row in time.

Two ways, chosen by a count of the right side:

* A small right side (a label series) becomes a lookup table of short sorted
  arrays, which is broadcast; left rows are neither shuffled nor sorted.
* Otherwise left and right rows are laid into one ordered stream and the last
  right row seen is carried along. The stream is cut into slices (see
  ``slices``), so neither a hot key nor a missing key puts it into one task.

Both are linear: no pairs of rows are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxline.operators.slices import (
    MAX_CUTS,
    ROWS_PER_SLICE,
    Slices,
    measured,
)

_BEFORE = Window.unboundedPreceding

# Right sides up to this size are broadcast as a lookup table.
LOOKUP_ROWS = 200_000
LOOKUP_TEXT_BYTES = 16_000_000
_UNROLLED = 12


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str] = (),
    take: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    direction: str = "backward",
    tolerance: str | None = None,
    how: str = "left",
    slices: Slices | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    lookup_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """Left rows with the columns ``take`` of the matching right row.

    backward: latest right row with ``right_on <= left_on``; forward: earliest
    with ``right_on >= left_on``. Of right rows at one time the one with the
    greatest (backward) or smallest (forward) ``tie`` wins. ``tolerance`` is an
    interval text such as ``"2 hours"``. ``how="inner"`` keeps matches only.
    Rows with a NULL time or key never match. ``take`` names must not clash
    with left columns. Fixed ``slices`` keep the plan lazy and always use the
    ordered stream; otherwise the right side is counted first.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, got {direction!r}")
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, got {how!r}")
    back = direction == "backward"
    take = [c for c in (take or right.columns) if c not in by]

    live = F.col(right_on).isNotNull()
    for k in by:
        live = live & F.col(k).isNotNull()
    right = right.filter(live)
    if slices is None:
        size = _measure(right, right_on, [*by, *tie, *take])
        if size["rows"] <= lookup_rows and size["text"] <= LOOKUP_TEXT_BYTES:
            return _lookup(left, right, left_on, right_on, by, take, tie, back, tolerance, how, size)
    return _stream(left, right, left_on, right_on, by, take, tie, back, tolerance, how, slices,
                   rows_per_slice)


def _entry(right_on: str, tie: Sequence[str], take: Sequence[str]):
    """A right row as one value that sorts by time and then tie."""
    return F.struct(
        F.col(right_on).alias("at"),
        F.struct(*([F.col(c) for c in tie] or [F.lit(0)])).alias("tie"),
        F.struct(*take).alias("row"),
    )


def _within(at, t, back: bool, tolerance: str | None):
    if tolerance is None:
        return F.lit(True)
    step = F.expr(f"INTERVAL {tolerance}")
    return (at + step >= t) if back else (at - step <= t)


# -- small right side -----------------------------------------------------


def _measure(right: DataFrame, right_on: str, columns: Sequence[str]) -> dict:
    """Rows, time range and bytes of variable-length columns of the right side."""
    fixed = ("string", "binary", "array", "map", "struct", "variant")
    loose = [c for c in dict.fromkeys(columns)
             if right.schema[c].dataType.simpleString().startswith(fixed)]
    text = F.lit(0)
    for c in loose:
        text = text + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    micros = F.unix_micros(F.col(right_on).cast("timestamp"))
    row = right.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text), F.lit(0)).alias("text"),
        F.min(micros).alias("lo"), F.max(micros).alias("hi"),
    ).first()
    return row.asDict()


def _lookup(left, right, left_on, right_on, by, take, tie, back, tolerance, how, size) -> DataFrame:
    """Broadcast arrays of right rows, one per key, or per time bucket if there
    is no key. The arrays together hold at most the counted rows (and one
    carried row per bucket)."""
    keys = [f"__k{i}" for i in range(len(by))]
    entry = _entry(right_on, tie, take)
    t = F.col(left_on)

    def bucket(ts):
        micros = F.unix_micros(ts.cast("timestamp"))
        at = F.floor((micros - size["lo"]) / width).cast("bigint")
        # Times outside the right side's range use its first or last bucket.
        return F.least(F.greatest(at, F.lit(0)), F.lit(last)).cast("bigint")

    rows = right.select(*[F.col(k).alias(n) for k, n in zip(by, keys)], right_on, entry.alias("__e"))
    if by:
        arrays = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("__e")).alias("__a"))
        longest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        placed = left.withColumns({n: F.col(k) for k, n in zip(by, keys)})
        on = keys
    else:
        span = (size["hi"] or 0) - (size["lo"] or 0) + 1
        width = max(1, span // max(1, size["rows"]))
        last = (span - 1) // width
        rows = rows.select(bucket(F.col(right_on)).alias("__b"), "__e")
        own = rows.groupBy("__b").agg(F.array_sort(F.collect_list("__e")).alias("__own"))
        every = left.sparkSession.range(0, last + 1 if size["rows"] else 0).select(
            F.col("id").alias("__b"))
        edge = F.element_at("__own", -1 if back else 1)
        order = F.col("__b").asc() if back else F.col("__b").desc()
        # At most one row per counted right row: one task can order them.
        w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(_BEFORE, -1)
        carried = F.last(edge, ignorenulls=True).over(w)
        mine = F.coalesce("__own", F.array().cast(own.schema["__own"].dataType))
        carry = F.when(F.col("__c").isNotNull(), F.array("__c")).otherwise(
            F.array().cast(own.schema["__own"].dataType))
        arrays = every.join(own, "__b", "left").withColumn("__c", carried).select(
            "__b", (F.concat(carry, mine) if back else F.concat(mine, carry)).alias("__a"))
        longest = (rows.groupBy("__b").count().agg(F.max("count")).first()[0] or 0) + 1
        placed = left.withColumn("__b", bucket(t))
        on = ["__b"]

    joined = placed.join(F.broadcast(arrays), on, "left")
    a = F.col("__a")
    if longest <= _UNROLLED:
        # Few entries: a chain of comparisons, which stays in generated code.
        order = reversed(range(longest)) if back else range(longest)
        best = F.lit(None)
        picks = []
        for i in order:
            e = F.get(a, F.lit(i))
            picks.append(F.when((e["at"] <= t) if back else (e["at"] >= t), e))
        best = F.coalesce(*picks) if picks else F.lit(None)
    else:
        jumps = F.array(*[F.lit(1 << b) for b in reversed(range(longest.bit_length()))])

        def passed(x):  # entries that lie before the wanted one
            return (x["at"] <= t) if back else (x["at"] < t)

        index = F.aggregate(
            jumps, F.lit(0),
            lambda at, jump: F.when(passed(F.get(a, at + jump - 1)), at + jump).otherwise(at))
        best = F.get(a, index - 1) if back else F.get(a, index)
    found = joined.withColumn("__m", best)
    hit = F.col("__m").isNotNull() & t.isNotNull() & _within(F.col("__m.at"), t, back, tolerance)
    found = found.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    if how == "inner":
        found = found.filter("__hit")
    return found.select(
        *left.columns,
        *[F.when(F.col("__hit"), F.col(f"__m.row.{c}")).alias(c) for c in take])


# -- any right side -------------------------------------------------------


def _stream(left, right, left_on, right_on, by, take, tie, back, tolerance, how, slices,
            rows_per_slice) -> DataFrame:
    # A left row's match depends on its time alone, so left rows of one time
    # may be told apart by a hash and land in different slices. Right rows of
    # that time come ahead of them all.
    far = -1 if back else (1 << 62)
    spread = F.abs(F.xxhash64(*left.columns) % (1 << 60))
    lrows = left.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)],
        F.col(left_on).alias("__t"),
        spread.alias("__spread"),
        F.struct(*left.columns).alias("__l"),
    )
    rrows = right.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)],
        F.col(right_on).alias("__t"),
        F.lit(far).cast("long").alias("__spread"),
        _entry(right_on, tie, take).alias("__r"),
    )
    keys = [f"__k{i}" for i in range(len(by))]
    stream = lrows.unionByName(rrows, allowMissingColumns=True)
    if slices is None:
        slices = measured(stream, ["__t", "__spread"], rows_per_slice, MAX_CUTS)

    if slices.width_seconds is not None:
        number = slices.number("__t")
    else:
        number = slices.number("__t", "__spread")
    stream = stream.withColumn("__slice", number)
    if slices.split:
        # What each (key, slice) with left rows must know of the slices before.
        best = (F.max if back else F.min)("__r")
        number_order = F.col("__slice").asc() if back else F.col("__slice").desc()
        earlier = Window.partitionBy(*keys).orderBy(number_order).rangeBetween(_BEFORE, -1)
        asks = stream.filter(F.col("__l").isNotNull()).select(*keys, "__slice").distinct()
        knows = stream.filter(F.col("__r").isNotNull()).groupBy(*keys, "__slice").agg(
            best.alias("__best"))
        heads = (
            asks.withColumn("__ask", F.lit(True))
            .unionByName(knows, allowMissingColumns=True)
            .withColumn("__r", F.last("__best", ignorenulls=True).over(earlier))
            .filter("__ask")
            .select(*keys, "__slice", "__r", F.lit(1).alias("__head"))
        )
        stream = stream.withColumn("__head", F.lit(0)).unionByName(
            heads, allowMissingColumns=True)
    else:
        stream = stream.withColumn("__head", F.lit(0))

    t, spread_c, tie_c = F.col("__t"), F.col("__spread"), F.col("__r.tie")
    order = [F.col("__head").desc()] + (
        [t.asc(), spread_c.asc(), tie_c.asc()] if back
        else [t.desc(), spread_c.desc(), tie_c.desc()]
    )
    w = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(_BEFORE, 0)
    matched = stream.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).filter(
        F.col("__l").isNotNull()
    )
    hit = F.col("__m").isNotNull() & t.isNotNull()
    for k in keys:
        hit = hit & F.col(k).isNotNull()
    hit = hit & _within(F.col("__m.at"), t, back, tolerance)
    matched = matched.withColumn("__hit", hit)
    if how == "inner":
        matched = matched.filter("__hit")
    return matched.select(
        "__l.*",
        *[F.when(F.col("__hit"), F.col(f"__m.row.{c}")).alias(c) for c in take],
    )
